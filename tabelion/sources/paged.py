"""Paged court sources as Spark data sources, for batches and for streams.

Both give raw JSON rows with provenance, and a few typed columns beside them, whose filters reach the source: cases by court, degree,
class and number, notices by court and day. What a filter asks for goes into the index query or thins out the partitions; Spark applies
it once more, so an index that matches too much does no harm. A limit on raw hits keeps filters of the index out, as they would
change which hits it counts.

A stream's offset is the cursor: of each court, the last hit's sort values (cases) or the next day (notices). The driver finds out where
the next stretch ends without fetching records; tasks fetch what lies between two cursors. A query that is started again from its
checkpoint goes on there.

Courts (and days) are dealt over a few lanes, each of which asks for one page after the other; all lanes together keep one request
interval, whatever runs at once. Parsing, privacy filters and classification are DataFrame operations in convert.py. The key of the case
index comes from the environment variable DATAJUD_API_KEY only. A transport can be given as "module:function", so tests and replays
need no network.
"""

from __future__ import annotations

import importlib
import itertools
import json
import os
from collections.abc import Iterator
from dataclasses import asdict
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tabelion.functions.courts import select
from tabelion.sources.config import CaseQuery, NoticeQuery
from tabelion.sources.http import Client, send

# Public addresses.
CASES_URL, NOTICES_URL = "https://api-publica.datajud.cnj.jus.br", "https://comunicaapi.pje.jus.br/api/v1/comunicacao"
#: What is landed, and the typed columns beside it.
ROW = "tribunal string, cursor string, hit string, proveniencia struct<url:string,metodo:string,parametros:string,coletado_em:string,sha256:string>"
CASE_ROW, NOTICE_ROW = f"{ROW}, numero string, grau string, classe_codigo int", f"{ROW}, dia date"
#: Index fields of the typed columns, and how they are matched.
FIELDS = {"numero": ("match", "numeroProcesso"), "grau": ("match", "grau"), "classe_codigo": ("match", "classe.codigo")}
#: Lanes that ask at the same time; records past which the index counts no further in one answer.
LANES, WINDOW = 4, 10_000


def case_query(q: CaseQuery, size: int, after: list | None = None, pushed: dict[str, list] | None = None) -> dict:
    """The index query: values of one criterion are alternatives, criteria (pushed ones, by column, too) add up; everything if there are none."""
    criteria = (("match", "assuntos.codigo", q.assuntos_codigos), ("match_phrase", "assuntos.nome", q.assuntos_nomes), ("match", "classe.codigo", q.classes_codigos), ("match", "grau", q.graus), *((*FIELDS[c], values) for c, values in (pushed or {}).items()))
    must = [{"bool": {"should": [{kind: {field: v}} for v in values], "minimum_should_match": 1}} for kind, field, values in criteria if values]
    body = {"size": size, "query": {"bool": {"must": must}} if must else {"match_all": {}}, "sort": [{"@timestamp": {"order": "asc"}}]}
    return body | ({"search_after": after} if after else {})


def case_pages(client: Client, court: str, q: CaseQuery, after: list | None = None, seen: int = 0, pushed: dict[str, list] | None = None, until: list | None = None) -> Iterator[tuple[list[dict], list | None, dict]]:
    """(hits, cursor, provenance) page by page, until an empty or short page, no cursor, the cursor until, or the limit of raw hits, of which seen were met before."""
    url = f"{CASES_URL}/api_publica_{court}/_search"
    while q.limite_por_tribunal is None or seen < q.limite_por_tribunal:
        size = q.tamanho_pagina if q.limite_por_tribunal is None else min(q.tamanho_pagina, q.limite_por_tribunal - seen)
        data, source = client.request("POST", url, body=case_query(q, size, after, pushed))
        hits = data.get("hits", {}).get("hits", [])
        full = len(hits) == size
        if until is not None:
            hits = [h for h in hits if h.get("sort") is not None and h["sort"] <= until]
            full &= len(hits) == size and hits[-1]["sort"] < until
        if hits:
            seen, after = seen + len(hits), hits[-1].get("sort")
            yield hits, after, source
        if not full or after is None:
            return


def case_end(client: Client, court: str, q: CaseQuery, after: list | None, seen: int, most: int) -> tuple[list | None, int]:
    """Where the next stretch of at most so many hits ends, and how many were met by then: one request that fetches cursors only."""
    size = min(most, WINDOW, most if q.limite_por_tribunal is None else q.limite_por_tribunal - seen)
    if size <= 0:
        return after, seen
    data, _ = client.request("POST", f"{CASES_URL}/api_publica_{court}/_search", body=case_query(q, size, after) | {"_source": False})
    hits = data.get("hits", {}).get("hits", [])
    return (hits[-1].get("sort"), seen + len(hits)) if hits and hits[-1].get("sort") else (after, seen)


def case_count(client: Client, court: str, q: CaseQuery) -> int:
    body = {k: v for k, v in case_query(q, 0).items() if k != "sort"} | {"track_total_hits": True}
    total = client.request("POST", f"{CASES_URL}/api_publica_{court}/_search", body=body)[0].get("hits", {}).get("total", 0)
    return int(total.get("value", 0) if isinstance(total, dict) else total)


def notice_pages(client: Client, court: str, day: date, q: NoticeQuery) -> Iterator[tuple[list[dict], dict]]:
    """(items, provenance) page by page of one day."""
    page = 1
    while True:
        params = {"siglaTribunal": court.upper(), "dataDisponibilizacaoInicio": day.isoformat(), "dataDisponibilizacaoFim": day.isoformat(), "pagina": page, "itensPorPagina": q.itens_por_pagina}
        data, source = client.request("GET", NOTICES_URL, params=params | ({"texto": q.texto} if q.texto else {}))
        items = data.get("items") or data.get("itens") or []
        if items:
            yield items, source
        if len(items) < q.itens_por_pagina:
            return
        page += 1


def days(q: NoticeQuery, resume: date | None = None) -> list[date]:
    first = resume or q.data_inicio or date.today() - timedelta(days=1)
    return [first + timedelta(days=i) for i in range(((q.data_fim or first) - first).days + 1)]


def _transport(name: str | None):
    if not name:
        return send
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def options(query: CaseQuery | NoticeQuery, courts: list[str], cursors: dict, transport: str | None = None) -> dict[str, str]:
    """Reader options; a transport of one's own keeps no interval."""
    plain = {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in asdict(query).items() if v is not None}
    found = {"courts": ",".join(courts), "query": json.dumps(plain), "cursors": json.dumps(cursors)}
    return found | ({"transport": transport, "interval": "0"} if transport else {})


class _Lane(InputPartition):
    """What one task asks for, one unit after the other: (court, day, cursor, end)."""

    def __init__(self, units: list[tuple], of: int):
        self.units, self.of = units, of


class _Source:
    """Options that batch and stream readers share."""

    def __init__(self, options: dict):
        self.options = options
        self.courts = select([c for c in options.get("courts", "todos").split(",") if c])
        self.query, self.transport = json.loads(options.get("query", "{}")), options.get("transport")
        self.cursors, self.interval = json.loads(options.get("cursors", "{}")), float(options.get("interval", "1"))
        self.most_lanes = int(options.get("lanes", LANES))

    def lanes(self, units: list[tuple]) -> list[_Lane]:
        n = min(self.most_lanes, len(units))
        return [_Lane(units[i::n], n) for i in range(n)]

    def client(self, lanes: int, headers: dict | None = None) -> Client:
        """Each lane keeps the interval as often as there are lanes, so that all together keep it."""
        return Client(_transport(self.transport), headers, self.interval * lanes)

    def case_client(self, lanes: int) -> Client:
        key = os.environ.get("DATAJUD_API_KEY")
        return self.client(lanes, {"Authorization": f"APIKey {key}"} if key else {})

    def case_query(self) -> CaseQuery:
        return CaseQuery(**{k: v for k, v in self.query.items() if not k.startswith("ajuizamento")})

    def notice_query(self) -> NoticeQuery:
        return NoticeQuery(**self.query | {k: date.fromisoformat(self.query[k]) for k in ("data_inicio", "data_fim") if self.query.get(k)})


def _raw(court: str, cursor: object, hit: dict, source: dict) -> tuple:
    return court, json.dumps(cursor), json.dumps(hit, ensure_ascii=False), tuple(source[k] for k in ("url", "metodo", "parametros", "coletado_em", "sha256"))


def _typed(hit: dict) -> tuple:
    """Number, degree and class code as convert.cases reads them, null where they are of another kind."""
    s = hit.get("_source") or {}
    kind = s.get("classe") if isinstance(s.get("classe"), dict) else {}
    told = lambda x: x if isinstance(x, str) else None if x is None else json.dumps(x)
    return told(s.get("numeroProcesso")), told(s.get("grau")), kind.get("codigo") if isinstance(kind.get("codigo"), int) and not isinstance(kind.get("codigo"), bool) else None


def _cases(source: _Source, lane: _Lane, pushed: dict[str, list], most: int | None = None) -> Iterator[tuple]:
    client, q = source.case_client(lane.of), source.case_query()
    for court, _, cursor, end in lane.units:
        seen = cursor.get("seen", 0)
        pages = case_pages(client, court, q, cursor.get("after"), seen, pushed, end.get("after") if end else None)
        for page, (hits, after, told) in enumerate(itertools.islice(pages, most), 1):
            seen += len(hits)
            for hit in hits:
                yield *_raw(court, {"page": page, "seen": seen, "after": after}, hit, told), *_typed(hit)


def _notices(source: _Source, lane: _Lane) -> Iterator[tuple]:
    client, q = source.client(lane.of), source.notice_query()
    for court, day, _, _ in lane.units:
        for items, told in notice_pages(client, court, date.fromisoformat(day), q):
            for item in items:
                yield *_raw(court, day, item, told), date.fromisoformat(day)


def _values(f: Filter) -> list | None:
    """The values that an equality or IN allows."""
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return None if f.value is None else [f.value]
    return list(f.value) if isinstance(f, In) and None not in f.value else None


class _Reader(_Source, DataSourceReader):
    def _pick_courts(self, f: Filter) -> bool:
        values = _values(f) if f.attribute == ("tribunal",) else None
        if values is not None:
            self.courts = [c for c in self.courts if c in values]
        return values is not None


class CaseReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.pushed: dict[str, list] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Courts thin out the partitions; other equalities join the index query. Spark checks them all again."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name and not self._pick_courts(f) and name in FIELDS and self.query.get("limite_por_tribunal") is None and (values := _values(f)) is not None:
                self.pushed[name] = [v for v in values if v in self.pushed[name]] if name in self.pushed else values
            yield f

    def partitions(self) -> list[_Lane]:
        none = any(not v for v in self.pushed.values())
        return self.lanes([] if none else [(c, None, self.cursors.get(c) or {}, None) for c in self.courts])

    def read(self, lane: _Lane) -> Iterator[tuple]:
        return _cases(self, lane, self.pushed, int(self.options["pages"]) if self.options.get("pages") else None)


class NoticeReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.first, self.last = date.min, date.max

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Courts and days thin out the partitions."""
        for f in filters:
            if getattr(f, "attribute", None) == ("dia",) and isinstance(getattr(f, "value", None), date):
                if isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + timedelta(days=isinstance(f, GreaterThan)))
                if isinstance(f, (EqualTo, EqualNullSafe, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value - timedelta(days=isinstance(f, LessThan)))
            elif hasattr(f, "attribute"):
                self._pick_courts(f)
            yield f

    def partitions(self) -> list[_Lane]:
        every = [(c, d) for c in self.courts for d in self.cursors.get(c, [d.isoformat() for d in days(self.notice_query())])]
        return self.lanes([(c, d, None, None) for c, d in every if self.first <= date.fromisoformat(d) <= self.last])

    def read(self, lane: _Lane) -> Iterator[tuple]:
        return _notices(self, lane)


class _StreamReader(_Source, DataSourceStreamReader):
    """The engine plans the last known stretch when a query starts again, which tells where it stands."""

    at: dict | None = None

    def advance(self, at: dict) -> dict:
        raise NotImplementedError

    def units(self, start: dict, end: dict) -> list[tuple]:
        raise NotImplementedError

    def initialOffset(self) -> dict:
        return {c: self.cursors.get(c) for c in self.courts}

    def latestOffset(self) -> dict:
        self.at = self.advance(self.at or self.initialOffset())
        return self.at

    def partitions(self, start: dict, end: dict) -> list[_Lane]:
        self.at = self.at or end
        return self.lanes(self.units(start, end))

    def commit(self, end: dict) -> None:
        pass


class CaseStreamReader(_StreamReader):
    """Offsets: of each court {after, seen}."""

    def advance(self, at: dict) -> dict:
        client, q, most = self.case_client(1), self.case_query(), int(self.options.get("pages", 20))
        found = {}
        for court, cursor in at.items():
            cursor = cursor or {"after": None, "seen": 0}
            after, seen = case_end(client, court, q, cursor["after"], cursor["seen"], most * q.tamanho_pagina)
            found[court] = {"after": after, "seen": seen}
        return found

    def units(self, start: dict, end: dict) -> list[tuple]:
        return [(c, None, start.get(c) or {}, e) for c, e in end.items() if e and e["after"] is not None and e != start.get(c)]

    def read(self, lane: _Lane) -> Iterator[tuple]:
        return _cases(self, lane, {})


class NoticeStreamReader(_StreamReader):
    """Offsets: of each court the next day. Days count once they are over; without a last day the stream goes on for good."""

    def initialOffset(self) -> dict:
        first = self.notice_query().data_inicio or date.today() - timedelta(days=1)
        return {c: self.cursors.get(c) or first.isoformat() for c in self.courts}

    def advance(self, at: dict) -> dict:
        last, most = self.notice_query().data_fim or date.max, int(self.options.get("days", 7))
        end = min(last, date.today() - timedelta(days=1)) + timedelta(days=1)
        return {c: max(d, min(date.fromisoformat(d) + timedelta(days=most), end).isoformat()) for c, d in at.items()}

    def units(self, start: dict, end: dict) -> list[tuple]:
        span = lambda a, b: range((date.fromisoformat(b) - date.fromisoformat(a)).days)
        return [(c, (date.fromisoformat(start[c]) + timedelta(days=i)).isoformat(), None, None) for c, e in end.items() for i in span(start[c], e)]

    def read(self, lane: _Lane) -> Iterator[tuple]:
        return _notices(self, lane)


class CaseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "court_cases"

    def schema(self) -> str:
        return CASE_ROW

    def reader(self, schema) -> DataSourceReader:
        return CaseReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaseStreamReader(self.options)


class NoticeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "court_notices"

    def schema(self) -> str:
        return NOTICE_ROW

    def reader(self, schema) -> DataSourceReader:
        return NoticeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return NoticeStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both sources known, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaseSource)
    spark.dataSource.register(NoticeSource)
