"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabelion.llm.common import table


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import permutation_index

    return permutation_index.neighbours(table(spark, sf_dir, "embeddings"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import quotes

    return quotes.link(table(spark, sf_dir, "conversations"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabelion.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import decontaminate

    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The contract's rules: host and path -> what to do.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def op5_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("purity")


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import jaccard_join

    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import katz

    return katz.score(table(spark, sf_dir, "documents"))


def op10_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import pii

    found = pii.spans(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{k}": count(k) for k in pii.BASE_KINDS}
    return found.withColumns(counts | {"base_sha256": F.sha2(joined("base"), 256), "n_spans": F.size("spans").cast("long"), "spans": joined("spans")}).drop("base")


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import warc

    return warc.archive(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import merkle

    return merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabelion.llm import tries

    return tries.trie(table(spark, sf_dir, "conversations"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabelion.llm import token_files

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_permutation_index, op2_byte_bpe, op3_quotation_linking, op4_cgk_decontamination, op5_url_template_tree, op6_ordinal_toxicity, op7_warc_bundles, op8_jaccard_join, op9_katz_backoff, op10_boosted_pii, op11_merkle_manifest, op12_prefix_trie, op13_token_files)}


#: op8: sets of five-word shingles, every pair that shares one, and the least id reachable.
OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.r)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


#: op7: the digest's 40 hexadecimal digits in eight groups of 20 bits, each four letters of base32.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS m FROM p GROUP BY h),
d AS (SELECT page_id, m, strlen(h) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(sha1(h), 1 + 5 * (i // 4)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest FROM p JOIN f USING (h))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN m < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m < page_id THEN m END AS refers_to FROM d
"""


def op5_sql(levels: int = 5) -> str:
    """The template tree, level by level, in SQL: more levels than the given tables have segments."""
    from tabelion.llm import url_filter as u

    fits = {r: f"(host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}')" for r in URL_RULES}
    longest = sorted(URL_RULES, key=lambda r: (-len(r), r))
    rule = " ".join(f"WHEN {fits[r]} THEN '{r}'" for r in longest)
    action = " ".join(f"WHEN rule = '{r}' THEN '{a}'" for r, a in URL_RULES.items())
    shape = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in u.SHAPES)
    parts = [f"""WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p0 AS (SELECT *, CASE {rule} END AS rule, list_transform(string_split(path, '/')[2:], lambda x: CASE {shape} WHEN regexp_matches(x, '^[{{\\\\]') THEN chr(92) || x ELSE x END) AS shapes FROM h),
p AS (SELECT page_id, host, path, rule, CASE {action} END AS action, shapes FROM p0),
t0 AS (SELECT host, shapes, count(*) AS n, count(action) AS l, count(*) FILTER (action = 'block') AS b, '' AS template FROM p GROUP BY host, shapes)"""]
    rate = "(all_b / greatest(all_l, 1))"
    for d in range(levels):
        parts.append(f"""s{d} AS (SELECT *, shapes[{d + 1}] AS seg, coalesce(CASE WHEN starts_with(shapes[{d + 2}], '{{') THEN shapes[{d + 2}] WHEN shapes[{d + 2}] IS NULL THEN '{{none}}' ELSE '{{literal}}' END, '{{none}}') AS below FROM t{d}),
k{d} AS (SELECT host, template, seg, below, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM s{d} WHERE seg IS NOT NULL AND NOT starts_with(seg, '{{') GROUP BY ALL),
c{d} AS (SELECT host, template, seg, sum(n) AS ofs, sum(l) AS l, sum(b) AS b FROM k{d} GROUP BY host, template, seg),
o{d} AS (SELECT host, template, below, sum(n) AS pool FROM k{d} GROUP BY host, template, below),
f{d} AS (SELECT host, template, count(*) - 1 AS freedom FROM o{d} GROUP BY ALL),
n{d} AS (SELECT host, template, sum(ofs) AS every, sum(l) AS all_l, sum(b) AS all_b, count_if(l = 0) AS plain, coalesce(sum(ofs) FILTER (l = 0), 0) AS all_plain FROM c{d} GROUP BY host, template),
x{d} AS (SELECT host, template, seg, c.ofs, c.l, c.b, every, all_l, all_b, plain, all_plain, freedom, sum(k.n * k.n / (c.ofs * pool / every)) AS ratio
 FROM k{d} k JOIN c{d} c USING (host, template, seg) JOIN n{d} USING (host, template) JOIN f{d} USING (host, template) JOIN o{d} USING (host, template, below) GROUP BY ALL),
a{d} AS (SELECT host, template, seg, variable, alike AND NOT variable AS alike FROM (SELECT host, template, seg, ratio - ofs <= CASE WHEN freedom > 0 THEN freedom * pow(1 - 2 / (9 * freedom) + {u.DEVIATE} * sqrt(2 / (9 * freedom)), 3) ELSE 0 END + 1e-6
 AND pow(b - l * {rate}, 2) <= {u.DEVIATE * u.DEVIATE} * l * {rate} * (1 - {rate}) + 1e-6 AS alike, l = 0 AND plain > 1 AND all_plain < {u.REPEATED} * plain AS variable FROM x{d})),
m{d} AS (SELECT *, min(seg) FILTER (alike) OVER w AS least, count_if(alike) OVER w AS together FROM a{d} WINDOW w AS (PARTITION BY host, template)),
t{d + 1} AS (SELECT host, shapes, n, l, b, CASE WHEN s.seg IS NULL THEN template ELSE template || '/' || CASE WHEN m.seg IS NULL THEN s.seg WHEN variable THEN '{{*}}' WHEN alike AND together > 1 THEN least || '~' ELSE s.seg END END AS template
 FROM s{d} s LEFT JOIN m{d} m USING (host, template, seg))""")
    last = f"t{levels}"
    parts.append(f"""hp AS (SELECT host, (sum(b) + {u.SMOOTHING} * {u.PRIOR}) / (sum(l) + {u.SMOOTHING}) AS hp FROM t0 GROUP BY host),
tp AS (SELECT host, template, sum(l) AS l, (sum(b) + {u.SMOOTHING} * any_value(hp)) / (sum(l) + {u.SMOOTHING}) AS purity FROM {last} JOIN hp USING (host) GROUP BY host, template)""")
    return ",\n".join(parts) + f"""
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN tp.purity >= {u.THRESHOLD} AND tp.l >= {u.MIN_LABELLED} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM p JOIN {last} USING (host, shapes) JOIN tp USING (host, template)"""


#: Unsigned CRC-32 of a short ASCII text, byte by byte with the usual table of 256 remainders (polynomial 0xEDB88320).
CRC_TABLE = """crc AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS r FROM range(256) x(i)))"""


def crc(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])))"


def op11_sql(source_levels: int = 5, top_levels: int = 4) -> str:
    """The tree level by level: 16 ** source_levels rows of a source, 16 ** top_levels sources."""
    from tabelion.llm import merkle

    n = merkle.FANOUT
    told = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen({x}::VARCHAR), ':', {x}) END"
    h = lambda text: "sha256(concat(" + ", ".join(map(told, ("doc_id", "source", "lang", "n_chars", text))) + "))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""WITH {CRC_TABLE}, l AS (SELECT doc_id, source, {h("text")} AS leaf, CASE WHEN {crc("doc_id::VARCHAR")} % 5 = 0 THEN {h(low)} END AS changed FROM documents, crc),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
n0 AS (SELECT source, i, leaf AS h, count(*) OVER (PARTITION BY source) AS c FROM d)"""]

    def rounds(name: str, levels: int) -> None:
        """A node that is alone goes up as it is; c: nodes of its source."""
        for k in range(levels):
            parts.append(f"""{name}{k + 1} AS (SELECT source, i // {n} AS i, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, list(h ORDER BY i) AS kids, any_value(c) AS below, ceil(any_value(c) / {n})::BIGINT AS c
 FROM {name}{k} GROUP BY source, i // {n})""")

    rounds("n", source_levels)
    parts.append(f"""m0 AS (SELECT 0 AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS c, source AS name FROM n{source_levels})""")
    rounds("m", top_levels)
    parts.append("p0 AS (SELECT doc_id, leaf, d.source, d.i, '' AS proof, coalesce(changed, leaf) AS f FROM d)")

    def climb(name: str, into: str, levels: int) -> None:
        for k in range(levels):
            pos = f"(p.i % {n})"
            left, right = f"array_to_string(kids[:{pos}], '')", f"array_to_string(kids[{pos} + 2:], '')"
            parts.append(f"""{into}{k + 1} AS (SELECT p.* EXCLUDE (i, proof, f), p.i // {n} AS i, concat(proof, {left}, {right}) AS proof, CASE WHEN below = 1 THEN f ELSE sha256(concat({left}, f, {right})) END AS f
 FROM {into}{k} p JOIN {name}{k + 1} x ON x.source IS NOT DISTINCT FROM p.source AND x.i = p.i // {n})""")

    climb("n", "p", source_levels)
    parts.append(f"q0 AS (SELECT doc_id, leaf, m0.h AS subroot, 0 AS source, m0.i, proof, f FROM p{source_levels} p JOIN m0 ON m0.name IS NOT DISTINCT FROM p.source)")
    climb("m", "q", top_levels)
    return ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{top_levels}, m{top_levels}"""


#: op12: sequences of turns as lists, every prefix of each, and all pairs of a node and its prefixes.
OP12_SQL = rf"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY i) AS xs, conv_id - conv_id % 20 AS base, {crc("conv_id::VARCHAR")} % 4 AS h FROM turns, crc GROUP BY conv_id, t),
every AS (SELECT a.conv_id, list_concat(coalesce(b.xs[:a.h], []), a.xs[a.h + 1:]) AS xs FROM own a LEFT JOIN own b ON b.conv_id = a.base),
members AS (SELECT conv_id, d, xs[:d] AS p, d = len(xs) AS ends FROM (SELECT *, unnest(range(len(xs) + 1)) AS d FROM every)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS told,
  CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(p[d].text, '[^ 	-
]+')) ELSE 0 END AS saved FROM members GROUP BY p, d),
kids AS (SELECT p[:d - 1] AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p, d)),
above AS (SELECT *, unnest(range(d + 1)) AS up FROM known),
sums AS (SELECT p[:up] AS p, up AS d, count_if(k = 0)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, o.conv_id AS parent_conv_id, a.n AS n_convs, a.k AS n_children, n_leaves, saved_tokens, sha256(a.told) AS ends_sha256
FROM known a JOIN sums USING (p, d) LEFT JOIN known o ON o.d = a.d - 1 AND o.p = a.p[:a.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_template_tree": op5_sql(), "op7_warc_bundles": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op11_merkle_manifest": op11_sql(), "op12_prefix_trie": OP12_SQL}
