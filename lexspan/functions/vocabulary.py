"""Closed vocabularies of legal citations. All of this module is fixed values, as plain text; rules that make patterns
of them are in grammar.py and families.py."""

from __future__ import annotations

# Letters that optical recognition puts for digits (never a digit for a digit), and letters for letters.
OCR_LETTERS = "OoQDlIi|!SsgqBGbZz"
OCR_DIGITS = "000011111559986622"
MISREAD = {"a": "@", "c": "e", "e": "c", "i": "l1|", "o": "0", "l": "1i|", "s": "5", "g": "9"}

#: Procedural classes: code -> names in full.
CLASS_NAMES = {
    "AREspE": "agravo em recurso especial eleitoral",
    "REspE": "recurso especial eleitoral",
    "AREsp": "agravo em recurso especial",
    "REsp": "recurso especial",
    "ARE": "recurso extraordinário com agravo, agravo em recurso extraordinário",
    "RE": "recurso extraordinário",
    "RHC": "recurso em habeas corpus, recurso ordinário em habeas corpus",
    "RMS": "recurso em mandado de segurança, recurso ordinário em mandado de segurança, recurso ord. em mandado de segurança",
    "RSE": "recurso em sentido estrito",
    "RR": "recurso de revista",
    "ARR": "recurso de revista com agravo",
    "AIRR": "agravo de instrumento em recurso de revista",
    "RRAg": "",
    "AgARR": "",
    "RO": "recurso ordinário eleitoral, recurso ordinário",
    "RCED": "recurso contra expedição de diploma",
    "Rp": "representação, recurso na representação",
    "HC": "habeas corpus criminal, habeas corpus",
    "MS": "mandado de segurança cível, mandado de segurança",
    "Rcl": "reclamação constitucional, reclamação",
    "AR": "ação rescisória",
    "AP": "ação penal",
    "ADI": "ação direta de inconstitucionalidade",
    "APL": "apelação criminal, apelação",
    "AgInt": "agravo interno criminal, agravo interno",
    "AgRg": "agravo regimental",
    "AI": "agravo de instrumento",
    "Ag": "agravo",
    "EDcl": "embargos de declaração criminal, embargos de declaração, embargos declaratórios",
    "EDiv": "embargos de divergência",
    "EINul": "embargos infringentes e de nulidade, embargos infringentes",
    "E": "recurso de embargos, embargos",
    "CC": "conflito de competência",
    "CJ": "conflito de jurisdição",
    "SLS": "suspensão de liminar e de sentença",
    "SS": "suspensão de segurança",
    "Pet": "petição",
    "PC": "prestação de contas",
    "CorPar": "correição parcial militar, correição parcial",
    "QO": "questão de ordem",
    "TCA": "tutela cautelar antecedente",
    "AC": "ação cautelar, cautelar inominada criminal",
    "AIJE": "ação de investigação judicial eleitoral",
    "PExt": "pedido de extensão",
    "ADPF": "arguição de descumprimento de preceito fundamental",
    "ADC": "ação declaratória de constitucionalidade",
    "ADO": "ação direta de inconstitucionalidade por omissão",
    "MI": "mandado de injunção",
    "HD": "habeas data",
    "Inq": "inquérito",
    "Ext": "extradição",
    "ACO": "ação cível originária",
    "RvC": "revisão criminal",
    "Cta": "consulta",
    "MC": "medida cautelar",
    "TP": "tutela provisória",
    "IRDR": "incidente de resolução de demandas repetitivas",
    "IUJ": "incidente de uniformização de jurisprudência, pedido de uniformização de interpretação de lei",
    "SL": "suspensão de liminar",
    "STA": "suspensão de tutela antecipada",
    "TST": "",
}
#: Short forms other than the code itself; a full stop may be left out or be followed by a space.
CLASS_SHORT = {
    "AREspE": "AREspEl AREspe", "REspE": "R.Esp.e. REspe REspEl REsp.El.", "AREsp": "A.R.Esp. AResp AgREsp AgResp Ag.REsp", "REsp": "R.Esp. Resp Rec.Esp. R.E.sp.",
    "RE": "R.E. Rext RExt", "RHC": "R.H.C. RHc", "RMS": "R.M.S. ROMS", "RSE": "R.S.E. RESE", "RO": "ROE ROEl R.O.", "Rp": "RRp R-Rp", "HC": "H.C. Hc", "MS": "M.S.",
    "Rcl": "Rcl. Recl.", "AP": "APn", "ADI": "ADIn", "APL": "Ap.Crim. ApCrim Ap.", "AgInt": "Ag.Int. AgInterno", "AgRg": "Ag.Rg. AgR Ag.Reg.", "AI": "AG", "Ag": "Ag.",
    "EDcl": "ED EDs Emb.Decl. E.Dcl. EDecl", "EDiv": "EREsp EDv Emb.Div. EAREsp", "EINul": "EIN EI", "Pet": "Pet.", "PC": "PCE", "CorPar": "CP", "TCA": "TutCautAnt",
    "Inq": "Inq.", "Ext": "Ext.", "RvC": "RvCr RevCrim", "Cta": "Cta.", "IUJ": "PUIL",
}
ORDINALS = "segundo segunda segundos terceiro terceira quarto quinto décimos décimo"
ACCESSORY = ("AgRg", "AgInt", "EDcl", "Ag", "QO", "PExt", "TST", "EDiv")
#: Suffixes of an incident glued to a number of the STF.
INCIDENTS = "AgR ED QO MC EDv"

COURTS = {
    "STF": "supremo tribunal federal, excelso pretório, suprema corte",
    "STJ": "superior tribunal de justiça",
    "TSE": "tribunal superior eleitoral",
    "TST": "tribunal superior do trabalho",
    "STM": "superior tribunal militar",
}
#: The court of a class that only one court has; of the justice digit of a unified number.
CLASSES_OF_COURT = {
    "STF": "ADPF ADC ADO Ext ACO STA RE ARE ADI",
    "STJ": "REsp AREsp RHC RMS EDiv SLS CC",
    "TSE": "REspE AREspE RCED AIJE Rp PC",
    "TST": "RR ARR AIRR RRAg AgARR E",
    "STM": "APL RSE EINul CorPar CJ",
}
COURT_OF_CLASS = {c: court for court, classes in CLASSES_OF_COURT.items() for c in classes.split()}
COURT_OF_DIGIT = {"5": "TST", "6": "TSE", "7": "STM", "3": "STJ"}
COURTESY = "colendo egrégio excelso"
COURTESY_SHORT = "c col e eg egr C E"
OTHER_COURTS = "tribunal de justiça, tribunal regional, turma nacional de uniformização, tribunal de contas"
STATES = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()

#: Laws: code -> names; a name in capitals is an acronym.
LAWS = {
    "CF": "constituição federal de 1988, constituição federal, constituição da república federativa do brasil, constituição da república, carta magna, carta da república, carta política, lei maior, texto constitucional, constituição, CF/88, CF/1988, CRFB/88, CRFB, CF",
    "L13105/2015": "novo código de processo civil, código de processo civil, novo cpc, CPC/2015, CPC/15, NCPC, CPC",
    "DL3689/1941": "código de processo penal, CPP",
    "L10406/2002": "código civil, CC/2002, CC",
    "DL5452/1943": "consolidação das leis do trabalho, CLT",
    "DL1001/1969": "código penal militar, CPM",
    "DL1002/1969": "código de processo penal militar, CPPM",
    "DL2848/1940": "código penal, CP",
    "L8078/1990": "código de defesa do consumidor, CDC",
    "L4737/1965": "código eleitoral, CE",
    "LC64/1990": "lei das inelegibilidades, lei de inelegibilidade",
    "L9504/1997": "lei das eleições",
    "L8069/1990": "estatuto da criança e do adolescente, ECA",
    "L5172/1966": "código tributário nacional, CTN",
}

#: Phrases that invoke a source without naming it, and their type.
VAGUE = {
    "jurisprudência pacífica desta Corte": "jurisprudencia",
    "jurisprudência consolidada dos tribunais superiores": "jurisprudencia",
    "entendimento sumulado sobre a matéria": "jurisprudencia",
    "precedente firmado em sede de recurso repetitivo": "jurisprudencia",
    "orientação jurisprudencial da Corte Superior": "jurisprudencia",
    "precedentes desta Casa em situações análogas": "jurisprudencia",
    "recente acórdão da Segunda Turma": "jurisprudencia",
    "reiterados precedentes do Superior Tribunal de Justiça": "jurisprudencia",
    "verbete sumular aplicável à espécie": "jurisprudencia",
    "dispositivo constitucional invocado na origem": "lei",
    "dispositivo legal de regência": "lei",
    "lei que disciplina a prescrição no caso": "lei",
    "artigo correspondente do Código de Processo Civil": "lei",
    "legislação de regência da matéria": "lei",
    "normas de regência da matéria": "lei",
}
#: Beginnings of sentences that lead to a citation.
SLOTS = (
    "A hipótese atrai a incidência", "A orientação firmada", "A parte recorrente apoia-se", "A pretensão encontra amparo expresso", "A propósito, veja-se",
    "A tese encontra respaldo", "A tese ora sustentada decorre diretamente", "Ampara a pretensão", "Ao apreciar", "Aplica-se à espécie, mutatis mutandis, o quanto decidido",
    "Como já se reconheceu", "Como se depreende", "Confira-se, a propósito,", "Corrobora essa leitura", "Cumpre destacar", "Cumpre lembrar",
    "Deixou o Tribunal de origem de aplicar", "Em caso análogo,", "Idêntica conclusão foi adotada", "Impõe-se a observância", "Incide, na espécie,", "Invoca-se, ainda,",
    "Merece registro", "Milita em favor da parte", "Nesse exato sentido caminha", "Nesse exato sentido caminham", "Nesse sentido, confira-se o julgamento", "Nos exatos termos",
    "Não destoa desse entendimento", "Não se pode ignorar", "O acórdão recorrido diverge frontalmente do que assentado", "O julgado hostilizado desconsiderou por completo",
    "Reforça o argumento", "Registre-se, por oportuno,", "Requer-se, com fundamento", "Também", "Toda a construção defensiva repousa", "Vale invocar", "Violou o acórdão recorrido",
)
ARTICLES = "o a os as no na nos nas do da dos das ao à aos às"
#: Heads of a vague reference; of a source that a sentence invokes; words for the act under attack, up to their ending.
HEADS = (
    "jurisprudência jurisprudências entendimento entendimentos precedente precedentes orientação verbete súmula enunciado dispositivo dispositivos lei leis "
    "legislação norma normas artigo acórdão acórdãos julgado julgados tese preceito diploma código decisão decisões"
)
SOURCE_HEADS = "jurisprudência entendimento precedente precedentes orientação verbete súmula enunciado dispositivo lei legislação norma normas julgados preceito diploma"
SOURCE_VERBS = "é foi são foram afastou afasta afastaram encerra encerrou incide incidem dispõe prevê determina estabelece assegura impõe autoriza veda"
ATTACKED = "recorrid agravad impugnad hostilizad embargad guerread"
LAW_STEMS = "dispositiv lei legisla norma artigo preceito diploma código codigo"
#: What ends a vague phrase.
PHRASE_ENDS = (
    "para", "que", "sob pena", "à qual", "ao qual", "aos quais", "às quais", "de resto", "no ponto", "cuja", "cujo", "de clareza", "invocado", "invocada", "de aplicação",
    "embora", "em que", "onde", "segundo o qual", "segundo a qual", "a qual", "o qual",
)
#: Formulas that open the closing part of a petition.
CLOSINGS = ("termos em que", "nestes termos", "é o parecer", "publique-se", "por tais fundamentos", "ante o exposto", "pelo exposto", "diante de todo o exposto", "diante do exposto")
MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()
RULING_HEADS = "julgado precedente acórdão aresto decisão"
RULING_QUALITIES = "recente unânime paradigma"
RULING_VERBS = "proferido julgado publicado prolatado decidido firmado"
THEME_QUALITIES = ("repetitivo", "de repercussão geral", "da repercussão geral", "de recursos repetitivos", "dos recursos repetitivos", "de recurso repetitivo")
THEME_TAILS = ("sistemática da repercussão geral", "sistemática dos recursos repetitivos", "repercussão geral", "recursos repetitivos", "recurso repetitivo", "recursos especiais repetitivos")
SENTENCE_ABBREVIATIONS = "art arts n nº no min rel rec esp fls fl ag int reg crim emb decl dcl c col e eg egr ap sr sra dr dra p pp inc al v cf ex des proc resp pet rcl recl súm sum j dje dj a s".split()

#: Confidence of a rule: before calibration, and after it.
PRIOR = {
    "real_unico": 0.99, "real_desempate": 0.85, "real_duplicata": 0.6, "inventada_ausente": 0.98, "inventada_tribunal": 0.8,
    "lei_real": 0.99, "lei_inventada": 0.97, "sumula_real": 0.99, "sumula_inventada": 0.97, "sumula_outro_tribunal": 0.97,
    "sumula_sem_tribunal": 0.6, "sumula_ambigua": 0.6, "tema": 0.9, "incompleta": 0.97, "incompleta_parcial": 0.8, "vaga": 0.97,
    "s2_real": 0.9, "s2_inventada": 0.8, "s2_incompleta": 0.8, "s2_vaga": 0.8, "s1_vaga": 0.8,
}
CALIBRATED = dict.fromkeys(
    "incompleta inventada_ausente lei_inventada lei_real real_desempate real_unico s1_vaga s2_vaga sumula_inventada sumula_outro_tribunal sumula_real tema vaga".split(), 1.0
)
