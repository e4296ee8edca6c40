"""Invented texts with what the operators must read in them; the registered queries deal them over the orders table.

All names, numbers and addresses are fictitious.
"""

from __future__ import annotations

#: ruling, outcome, outcome of the action ('' for none), type, confidence; the first 41 are one for each rule, in order.
RULINGS = (
    ("Julgo parcialmente procedentes os pedidos.", "parcialmente_procedente", "parcialmente_procedente", "sentenca", "alta"),
    ("Acolho em parte o pedido do autor.", "parcialmente_procedente", "parcialmente_procedente", "sentenca", "alta"),
    ("Acolho em parte os embargos à execução.", "parcialmente_procedente", "parcialmente_procedente", "sentenca", "alta"),
    ("Acolho os embargos de terceiro.", "procedente", "procedente", "sentenca", "alta"),
    ("Rejeito os embargos do devedor.", "improcedente", "improcedente", "sentenca", "alta"),
    ("Acolho parcialmente os embargos monitórios.", "parcialmente_procedente", "parcialmente_procedente", "sentenca", "alta"),
    ("Acolho os embargos à ação monitória.", "improcedente", "improcedente", "sentenca", "alta"),
    ("Rejeito os embargos monitórios.", "procedente", "procedente", "sentenca", "alta"),
    ("Concedo em parte a segurança.", "parcialmente_procedente", "parcialmente_procedente", "sentenca", "alta"),
    ("Concedo a segurança.", "procedente", "procedente", "sentenca", "alta"),
    ("Denego a segurança.", "improcedente", "improcedente", "sentenca", "alta"),
    ("Absolvo o acusado.", "improcedente", "improcedente", "sentenca", "alta"),
    ("Condeno o réu como incurso no tipo penal.", "procedente", "procedente", "sentenca", "alta"),
    ("Pronuncio a prescrição.", "improcedente", "improcedente", "sentenca", "media"),
    ("Reconheço a decadência.", "improcedente", "improcedente", "sentenca", "media"),
    ("Extingo o feito com base no art. 487, II, do CPC.", "improcedente", "improcedente", "sentenca", "media"),
    ("Verifico o reconhecimento jurídico do pedido.", "procedente", "procedente", "sentenca", "media"),
    ("Anoto a renúncia à pretensão.", "improcedente", "improcedente", "sentenca", "media"),
    ("Homologo a transação.", "homologacao_acordo", "homologacao_acordo", "sentenca", "alta"),
    ("Homologo a desistência.", "extinto_sem_merito", "extinto_sem_merito", "sentenca", "alta"),
    ("Encerro o feito sem resolução do mérito.", "extinto_sem_merito", "extinto_sem_merito", "sentenca", "alta"),
    ("Extingo a execução na forma do art. 485 do CPC.", "extinto_sem_merito", "extinto_sem_merito", "sentenca", "alta"),
    ("Indefiro a petição inicial.", "extinto_sem_merito", "extinto_sem_merito", "sentenca", "alta"),
    ("Julgo extinto o processo.", "extinto_sem_merito", "extinto_sem_merito", "sentenca", "baixa"),
    ("Julgo improcedente a demanda.", "improcedente", "improcedente", "sentenca", "alta"),
    ("Rejeito integralmente os pedidos.", "improcedente", "improcedente", "sentenca", "alta"),
    ("Julgo procedente a demanda.", "procedente", "procedente", "sentenca", "alta"),
    ("Acolho integralmente os pedidos.", "procedente", "procedente", "sentenca", "alta"),
    ("Condeno a requerida ao pagamento.", "procedente", "procedente", "sentenca", "baixa"),
    ("Acolho em parte os embargos.", "indeterminado", "", "embargos_declaracao", "baixa"),
    ("Acolho os embargos.", "indeterminado", "", "embargos_declaracao", "baixa"),
    ("Rejeito os embargos.", "indeterminado", "", "embargos_declaracao", "baixa"),
    ("Dou parcial provimento ao recurso.", "parcialmente_provido", "", "acordao", "alta"),
    ("Nego provimento ao recurso.", "nao_provido", "", "acordao", "alta"),
    ("Dou provimento ao recurso.", "provido", "", "acordao", "alta"),
    ("Cassa-se a sentença.", "provido", "", "acordao", "media"),
    ("Não conheço do recurso.", "nao_conhecido", "", "acordao", "alta"),
    ("Julgo prejudicado o recurso.", "nao_conhecido", "", "acordao", "media"),
    ("Reformo em parte a sentença.", "parcialmente_provido", "", "acordao", "baixa"),
    ("Reformo a sentença.", "provido", "", "acordao", "baixa"),
    ("Mantenho a sentença.", "nao_provido", "", "acordao", "baixa"),
    # several commands, objects beside the action, negations
    ("Julgo procedente o pedido de restituição e improcedente o de danos morais.", "parcialmente_procedente", "parcialmente_procedente", "sentenca", "media"),
    ("Julgo improcedente a reconvenção e procedente o pedido inicial.", "procedente", "procedente", "sentenca", "alta"),
    ("Afasto a prescrição e julgo procedente a ação.", "procedente", "procedente", "sentenca", "alta"),
    ("Julgo procedente o pedido contraposto.", "indeterminado", "", "outro", "baixa"),
    ("Rejeito o incidente e julgo improcedentes os pedidos.", "improcedente", "improcedente", "sentenca", "alta"),
    ("Homologo o acordo quanto ao primeiro réu e julgo procedente o pedido quanto ao segundo.", "procedente", "procedente", "sentenca", "media"),
    ("Dou provimento ao recurso para julgar procedente o pedido.", "provido", "procedente", "acordao", "alta"),
    ("Dou provimento ao recurso do autor e nego provimento ao recurso do réu.", "indeterminado", "", "acordao", "baixa"),
    ("Não conheço do recurso adesivo e nego provimento ao principal.", "nao_provido", "", "acordao", "media"),
    ("Não conheço de parte do recurso e, na parte conhecida, nego-lhe provimento.", "nao_provido", "", "acordao", "alta"),
    ("Rejeito os embargos de declaração.", "indeterminado", "", "embargos_declaracao", "baixa"),
    ("Intime-se o autor para juntar documentos.", "indeterminado", "", "outro", "baixa"),
)
#: reason that a dismissal is given
DISMISSALS = (
    ("Julgo extinto o processo, nos termos do art. 485, VI, do CPC.", "ilegitimidade ou falta de interesse (art. 485, VI)"),
    ("Sem resolução do mérito, pelo abandono da causa.", "abandono da causa (art. 485, III)"),
    ("Sem resolução do mérito, ante a litispendência.", "perempção, litispendência ou coisa julgada (art. 485, V)"),
    ("Sem resolução do mérito, por convenção de arbitragem.", "convenção de arbitragem (art. 485, VII)"),
    ("Sem resolução do mérito, por inépcia da inicial.", "indeferimento da inicial (art. 485, I)"),
    ("Sem resolução do mérito, por ausência de pressupostos processuais.", "falta de pressuposto processual (art. 485, IV)"),
    ("Homologo a desistência da ação.", "desistência (art. 485, VIII)"),
    ("Indefiro a inicial.", "indeferimento da inicial (art. 485, I)"),
    ("Extingo o feito sem exame do mérito.", None),
)
#: whole decision, report, grounds, ruling, whether the ruling was found, outcome, vote
DECISIONS = (
    ("Fatos narrados.\nÉ o relatório.\nRazões do juízo.\nAnte o exposto, julgo procedente o pedido.", "Fatos narrados.\nÉ o relatório.", "Razões do juízo.", "Ante o exposto, julgo procedente o pedido.", True, "procedente", None),
    ("Vistos.\nDispensado o relatório.\nDecido.\nRazões.\nDISPOSITIVO\nJulgo improcedente o pedido.", "Vistos.\nDispensado o relatório.", "Decido.\nRazões.", "DISPOSITIVO\nJulgo improcedente o pedido.", True, "improcedente", None),
    ("Pedido de cobrança. Nego provimento ao recurso por unanimidade.", "", "Pedido de cobrança.", "Nego provimento ao recurso por unanimidade.", True, "nao_provido", True),
    ("Vistos. Vistos. Vistos. Vistos.\nIsto posto, dou provimento ao recurso.\nVOTO VENCIDO\nIsto posto, nego provimento ao recurso.", "", "Vistos. Vistos. Vistos. Vistos.", "Isto posto, dou provimento ao recurso.", True, "provido", None),
    ("ACORDAM os juízes, por maioria, dar provimento ao recurso.\nÉ o relatório.\nAnte o exposto, nego provimento ao recurso.", "ACORDAM os juízes, por maioria, dar provimento ao recurso.\nÉ o relatório.", "", "ACORDAM os juízes, por maioria, dar provimento ao recurso.", True, "provido", False),
)
#: text, references in order, joined by a bar
CITED = (
    ("art. 6º, VIII, do Código de Defesa do Consumidor", "art. 6 CDC"), ("art. 186 do CC/02 e art. 5º-A", "art. 186 CC|art. 5-A"), ("artigo 1022 da Lei 13.105/15", "art. 1.022 CPC"),
    ("Lei nº 9099/95 e Lei Federal 8.213/1991", "Lei 9.099/1995|Lei 8.213/1991"), ("Lei Complementar nº 1.012/07", "LC 1.012/2007"), ("Lei 1.060/50", "Lei 1.060/1950"),
    ("Súmula Vinculante 11 do Supremo Tribunal Federal", "Súmula Vinculante 11 STF"), ("Súmula nº 297, do Colendo STJ; súmula 7 do TJSP", "Súmula 297 STJ|Súmula 7 TJSP"),
    ("Tema 1.061 do STJ e Tema 793", "Tema 1.061 STJ|Tema 793"), ("art. 5º, XXXV, da Constituição Federal de 1988", "art. 5 CF"), ("art. 20, § 2º, do CDC; art. 98, § 3º, do CPC/15", "art. 20 CDC|art. 98 CPC"),
    ("art. 7 da CRFB/88, art. 3 da CLT e art. 4 do ECA", "art. 7 CF|art. 3 CLT|art. 4 ECA"), ("art. 2º da Lei 8.078/90; Lei 8.078/90", "art. 2 CDC|Lei 8.078/1990"), ("sem citação", ""),
)
#: ruling, categories and amounts in order
AMOUNTS = (
    ("Condeno a ré a pagar R$ 5.000,00 por danos morais.", "danos_morais=5000.0"), ("Danos materiais de R$ 1.234,5; lucros cessantes de R$ 2 mil.", "danos_materiais=1234.5|lucros_cessantes=2000.0"),
    ("Restituição de R$ 350; multa de R$ 1 milhão.", "restituicao=350.0|multa=1000000.0"), ("Declaro a inexistência do débito de R$ 99,90.", "debito_inexigivel=99.9"),
    ("Honorários de R$ 1.500,00; custas de R$ 80,00; pensão de R$ 700,00.", "honorarios=1500.0|custas=80.0|pensao=700.0"), ("Fixo o valor da causa em R$ 10.000,00.", "valor_causa=10000.0"),
    ("Pague R$ 12,34 em dez dias.", "outros=12.34"), ("Nada a pagar.", ""),
)
#: ruling, fees in per cent, their base, doubling, begins of interest, rate, begins of correction, index, legal aid, amount per claimant
CALCULATIONS = (
    ("Julgo procedente o pedido, com honorários de 10% sobre o valor da causa.", 10.0, "valor da causa", None, "", None, "", None, False, False),
    ("Julgo procedente o pedido. Honorários em quinze por cento do valor da condenação. Gratuidade deferida.", 15.0, "valor da condenação", None, "", None, "", None, True, False),
    ("Julgo procedente o pedido para restituir em dobro, com juros de 1% ao mês desde a citação e correção monetária pelo INPC a partir do desembolso.", None, None, "em dobro", "citação", "1% ao mês", "desembolso", "INPC", False, False),
    ("Julgo procedente o pedido pela devolução de forma simples; juros pela taxa Selic a partir do evento danoso.", None, None, "simples", "evento danoso", "Selic", "", None, False, False),
    ("Julgo procedente o pedido: correção monetária pelo IPCA-E desde o arbitramento, juros do art. 406 do CC a contar do vencimento, para cada autor.", None, None, None, "vencimento", "taxa legal (art. 406 CC)", "arbitramento", "IPCA-E", False, True),
)
#: text, text with pseudonyms, what was replaced
PERSONAL = (
    ("Autor: João da Silva. João da Silva pede.", "Autor: [PESSOA_1]. [PESSOA_1] pede.", "PESSOA=2"), ("Maria Souza Lima, brasileira, casada.", "[PESSOA_1], brasileira, casada.", "PESSOA=1"),
    ("Réu: Banco Alfa S.A. nada deve.", "Réu: Banco Alfa S.A. nada deve.", ""), ("Advogado Pedro Rocha (OAB/SP 123.456) falou.", "Advogado [PESSOA_1] ([OAB]) falou.", "OAB=1|PESSOA=1"),
    ("CPF 123.456.789-09 e e-mail ana@exemplo.com.br.", "CPF [CPF] e e-mail [EMAIL].", "CPF=1|EMAIL=1"), ("CNPJ 12.345.678/0001-95, CEP 01310-100.", "CNPJ [CNPJ], [CEP].", "CEP=1|CNPJ=1"),
    ("RG 12.345.678-9; fone (11) 98765-4321 e fim.", "[RG]; fone [TELEFONE] e fim.", "RG=1|TELEFONE=1"), ("Rua das Flores, 123, apto 4; agência 1234 e fim.", "[ENDERECO]; [CONTA] e fim.", "CONTA=1|ENDERECO=1"),
    ("Nada pessoal aqui.", "Nada pessoal aqui.", ""),
)
#: code, name, outcome of a movement
MOVEMENTS = (
    (219, "x", "procedente"), (220, None, "improcedente"), (221, "", "parcialmente_procedente"), (11376, "x", "extinto_sem_merito"), (11377, "x", "extinto_sem_merito"), (11378, "x", "extinto_sem_merito"),
    (0, "Procedência em Parte", "parcialmente_procedente"), (0, "Prescrição", "improcedente"), (0, "Improcedência", "improcedente"), (0, "Procedência", "procedente"), (0, "Homologação de Acordo", "homologacao_acordo"),
    (0, "Abandono da causa", "extinto_sem_merito"), (0, "Provimento em Parte", "parcialmente_provido"), (0, "Não-Provimento", "nao_provido"), (0, "Provimento", "provido"), (0, "Não conhecimento de recurso", "nao_conhecido"),
    (219, "Embargos de Declaração - Procedência", None), (220, "Concessão de liminar", None), (26, "Distribuição", None), (None, None, None),
)
#: movements as code@time, outcome and time of the first that judges
HISTORIES = (
    ("26@2020-01-01|219@2020-03-01|220@2020-02-01", "improcedente", "2020-02-01"), ("26@2020-01-01", "indeterminado", None), ("221@2021-05-05", "parcialmente_procedente", "2021-05-05"),
    ("11376@2022-01-02|219@2022-01-02", "extinto_sem_merito", "2022-01-02"), ("", "indeterminado", None),
)
#: text, its argumentative sentences joined by a bar
ARGUED = (
    ("Diante disso, cabe razão ao autor. O céu é azul.", "Diante disso, cabe razão ao autor."), ("É cediço que houve dano. Com efeito, há prova. Nada mais.", "É cediço que houve dano.|Com efeito, há prova."),
    ("Sem marca alguma. Outra frase.", ""),
)
#: text, legal terms in it with counts
TERMED = (
    ("Dano moral e danos morais; DANO  MORAL.", "dano moral=2|danos morais=1"), ("Litigância de má-fé: má-fé provada, prescrição.", "litigância de má-fé=1|má-fé=2|prescrição=1"), ("Nada.", ""),
)
#: date as written, date
DATES = (("20200131", "2020-01-31"), ("20200131120000", "2020-01-31"), ("2020-01-31T10:00:00.000Z", "2020-01-31"), ("31/01/2020", None), ("20201399", None), ("", None))
#: subjects as JSON, their names joined by a bar
SUBJECTS = (('[{"codigo":1,"nome":"A"},{"codigo":2,"nome":"B"}]', "A|B"), ('[[{"codigo":1,"nome":"A"}],{"codigo":3,"nome":"C"}]', "A|C"), ("[]", ""), ('["x"]', ""), (None, ""))
#: case number as written, canonical valid number or null, its court
NUMBERED = (
    ("autos 0000001-78.2020.8.26.0100 em curso", "0000001-78.2020.8.26.0100", "tjsp"), ("00000017820208260100", "0000001-78.2020.8.26.0100", "tjsp"), ("0000001-77.2020.8.26.0100", None, None), ("sem número", None, None),
)
#: ruling, its chapters as object/outcome/strength, joined by a bar
CHAPTERS = (
    ("Julgo procedente a reconvenção e improcedente o pedido inicial.", "reconvencao/procedente/forte|acao/improcedente/forte"),
    ("Rejeito os embargos de declaração. Nego provimento ao recurso.", "embargos_declaracao/nao_provido/forte|recurso/nao_provido/forte"),
    ("Julgo improcedente a denunciação da lide. Condeno o réu a pagar.", "denunciacao/improcedente/forte|acao/procedente/fraca"), ("Julgo procedente o pedido contraposto.", "pedido_contraposto/procedente/forte"),
    ("Rejeito o incidente e julgo improcedentes os pedidos.", "acao/improcedente/forte"), ("Reformo a sentença para julgar procedente o pedido.", "recurso/provido/fraca|acao/procedente/forte"),
)
