"""Word lists, patterns and limits that the results depend on.

Patterns are kept in the common subset of Java and RE2 syntax wherever one
exists; replacements use ``$1`` for the first group.
"""

# Trading name that documents, boilerplate and messages carry.
SUPPLIER = "KRONA"

# White space as document text really contains it (plain, no-break, thin).
WS = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+"

# Accent table of the match normaliser (upper case only).
ACCENTED = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
UNACCENTED = "AAAAAEEEEIIIIOOOOOUUUUCN"

# Acronyms spelled out in catalogue descriptions.
ACRONYMS = [
    (r"\bSR\b", "SERIE REFORCADA"),
    (r"\bESG\b", "ESGOTO"),
    (r"\bROSC\b", "ROSCAVEL"),
    (r"\bSOLD\b", "SOLDAVEL"),
    (r"\bSEC\b", "SECUNDARIO"),
    (r"\bPRIM\b", "PRIMARIO"),
]

# Match cleaner: what is removed first, then the ordered abbreviation rules.
NOISE_PREFIX = r"^\s*(?:FVM|FV|REF|COD|PROD|MAT|ART|ITEM)\s*[-:]\s*"
STANDARD_NUMBER = r"\s*[-–]?\s*NBR\s*\d+"
BOILERPLATE_TAIL = r"\bDEVERAO SER ENVIADOS JUNTAMENTE COM A NF.*$"
ABBREVIATIONS = [
    (r"\bTUB\b", "TUBO"),
    (r"\bJOE\b", "JOELHO"),
    (r"\bJOEL\b", "JOELHO"),
    (r"\bLUV\b", "LUVA"),
    (r"\bADAP\b", "ADAPTADOR"),
    (r"\bREG\b", "REGISTRO"),
    (r"\bRED\b", "REDUCAO"),
    (r"\bCAP\b", "CAP"),
    (r"\bJUNC\b", "JUNCAO"),
    (r"\bJUN\b", "JUNCAO"),
    (r"\bSOLD\b", "SOLDAVEL"),
    (r"\bSOLDAV\b", "SOLDAVEL"),
    (r"\bESG\b", "ESGOTO"),
    (r"\bESGT\b", "ESGOTO"),
    (r"\bPRIM\b", "ESGOTO"),
    (r"(\d)(MM)\b", "$1 MM"),
    (r"\bDN(\d)", "DN $1"),
    (r"(\d)X(\d)", "$1 X $2"),
    (r"[-–/|;]+", " "),
]

# Technical normaliser of the vector stage.
TECHNICAL_TERMS = [
    (r"\bTUB\b", "TUBO"), (r"\bTUBS\b", "TUBO"),
    (r"\bJOE\b", "JOELHO"), (r"\bJOEL\b", "JOELHO"), (r"\bJOELH\b", "JOELHO"),
    (r"\bCURV\b", "CURVA"), (r"\bLUV\b", "LUVA"),
    (r"\bADAP\b", "ADAPTADOR"), (r"\bADAPT\b", "ADAPTADOR"),
    (r"\bREG\b", "REGISTRO"), (r"\bREGIST\b", "REGISTRO"),
    (r"\bRED\b", "REDUCAO"), (r"\bREDUC\b", "REDUCAO"),
    (r"\bJUNC\b", "JUNCAO"), (r"\bJUN\b", "JUNCAO"),
    (r"\bBUCH\b", "BUCHA"), (r"\bFLANG\b", "FLANGE"), (r"\bUNI\b", "UNIAO"),
    (r"\bVALV\b", "VALVULA"), (r"\bTAMP\b", "TAMPA"),
    (r"\bSOLD\b", "SOLDAVEL"), (r"\bSOLDAV\b", "SOLDAVEL"),
    (r"\bROSC\b", "ROSCAVEL"), (r"\bROSCAV\b", "ROSCAVEL"),
    (r"\bESG\b", "ESGOTO"), (r"\bESGT\b", "ESGOTO"),
    (r"\bPRIM\b", "PRIMARIO"), (r"\bSEC\b", "SECUNDARIO"),
    (r"\bSR\b", "SERIE REFORCADA"), (r"\bREFORC\b", "SERIE REFORCADA"),
    (r"\bULTRA\b", "ULTRATERM"),
    (r"\b1/4\s*[\"']?\b", "6MM"), (r"\b3/8\s*[\"']?\b", "10MM"),
    (r"\b1/2\s*[\"']?\b", "15MM"), (r"\b3/4\s*[\"']?\b", "20MM"),
    (r"\b1\s*[\"']\b", "25MM"), (r"\b1\s*1/4\s*[\"']?\b", "32MM"),
    (r"\b1\s*1/2\s*[\"']?\b", "40MM"), (r"\b2\s*[\"']\b", "50MM"),
    (r"\b3\s*[\"']\b", "75MM"), (r"\b4\s*[\"']\b", "100MM"),
    (r"(\d)(MM)\b", "$1 MM"), (r"\bDN(\d)", "DN $1"), (r"(\d)X(\d)", "$1 X $2"),
    (r"[-–/|;]+", " "),
]
TECHNICAL_ACCENTED = "ÃÁÀÂÉÊÍÓÔÚÇÕ"
TECHNICAL_UNACCENTED = "AAAAEEIOOUCO"

# Synonym enrichment: the first pattern that hits appends its text.
SYNONYM_TEXTS = [
    (r"PORTA\s*GRELHA.*?CX\.?SIF\.?\s*100", "PORTA GRELHA PVC QUADRADA BRANCA 100MM 100X100MM CAIXA SIFONADA"),
    (r"PORTA\s*GRELHA.*?CX\.?SIF\.?\s*150", "PORTA GRELHA PVC QUADRADA BRANCA 150MM 150X150MM CAIXA SIFONADA"),
    (r"PORTA\s*GRELHA.*?100X100", "PORTA GRELHA PVC QUADRADA BRANCA 100MM 100X100MM"),
    (r"PORTA\s*GRELHA.*?150X150", "PORTA GRELHA PVC QUADRADA BRANCA 150MM 150X150MM"),
    (r"GRELHA.*?QUADR.*?100", "GRELHA QUADRADA BRANCA PVC 100MM CAIXA SIFONADA"),
    (r"GRELHA.*?QUADR.*?150", "GRELHA QUADRADA BRANCA PVC 150MM CAIXA SIFONADA"),
    (r"ELETRODUTO.*?RIGIDO.*?SOLDAVEL\s*20MM", "ELETRODUTO PVC RIGIDO SOLDAVEL 20MM 3/4 POLEGADA"),
    (r"ELETRODUTO.*?RIGIDO.*?SOLDAVEL\s*25MM", "ELETRODUTO PVC RIGIDO SOLDAVEL 25MM 1 POLEGADA"),
    (r"ELETRODUTO.*?RIGIDO.*?SOLDAVEL\s*32MM", "ELETRODUTO PVC RIGIDO SOLDAVEL 32MM 1.1/4 POLEGADA"),
    (r"ELETRODUTO.*?RIGIDO.*?SOLDAVEL\s*40MM", "ELETRODUTO PVC RIGIDO SOLDAVEL 40MM 1.1/2 POLEGADA"),
    (r"ELETRODUTO.*?RIGIDO.*?SOLDAVEL\s*50MM", "ELETRODUTO PVC RIGIDO SOLDAVEL 50MM 2 POLEGADAS"),
    (r"ELETRODUTO.*?RIGIDO.*?[^\d]3/4\b", "ELETRODUTO PVC RIGIDO SOLDAVEL 20MM 3/4 POLEGADA"),
    (r"ELETRODUTO.*?RIGIDO.*?[\s\D]1[\s'\"]", "ELETRODUTO PVC RIGIDO SOLDAVEL 25MM 1 POLEGADA"),
    (r"ELETRODUTO.*?RIGIDO.*?1\s*1/4", "ELETRODUTO PVC RIGIDO SOLDAVEL 32MM 1.1/4 POLEGADA"),
    (r"ELETRODUTO.*?RIGIDO.*?1\s*1/2", "ELETRODUTO PVC RIGIDO SOLDAVEL 40MM 1.1/2 POLEGADA"),
    (r"ELETRODUTO.*?RIGIDO.*?[\s\D]2[\s'\"]", "ELETRODUTO PVC RIGIDO SOLDAVEL 50MM 2 POLEGADAS"),
    (r"ELETRODUTO.*?FLEX.*?20MM", "ELETRODUTO PVC FLEXIVEL CORRUGADO 20MM 3/4 POLEGADA"),
    (r"ELETRODUTO.*?FLEX.*?25MM", "ELETRODUTO PVC FLEXIVEL CORRUGADO 25MM 1 POLEGADA"),
    (r"ELETRODUTO.*?FLEX.*?32MM", "ELETRODUTO PVC FLEXIVEL CORRUGADO 32MM 1.1/4 POLEGADA"),
    (r"TE\s*RED.*?SOLD.*?25\s*X\s*20", "TE REDUCAO PVC SOLDAVEL 25X20MM MARROM CLASSE 15 90 GRAUS"),
    (r"TE\s*RED.*?SOLD.*?32\s*X\s*25", "TE REDUCAO PVC SOLDAVEL 32X25MM MARROM CLASSE 15 90 GRAUS"),
]

# Boilerplate that some order layouts glue to a description.
BOILERPLATE_MARKS = (r"DEVER[AÃ]O\s*SER\s*ENVIAD|CERTIFICAD[OI]\s*DE\s*QUALIDADE"
                     r"|PROGRAMA\s*SETORIAL\s*DA\s*QUALIDADE")

# Categories of an order description: pattern found earliest wins.
CATEGORIES = [
    ("QUADRO", r"\bQUADRO\b"),
    ("CAIXA", r"\bCAIXA\b|\bCX\.?\b"),
    ("ELETRODUTO", r"\bELETROD(?:UTO)?\b|\bCORRUGAD[OA]\b"),
    ("TUBO", r"\bTUBO\b"),
    ("JOELHO", r"\bJOELHO\b|\bCURVA\b"),
    ("TE", r"\bTEE?\b"),
    ("LUVA", r"\bLUVA\b"),
    ("BUCHA", r"\bBUCHA\b"),
    ("REDUCAO", r"\bREDU(?:CAO|C)\b|\bRED\.?\b"),
    ("ADAPTADOR", r"\bADAPTADOR\b|\bADAPT\.?\b"),
    ("CAP", r"\bCAP\b"),
    ("REGISTRO", r"\bREGISTRO\b|\bREG\.?\b"),
    ("VALVULA", r"\bVALVULA\b|\bVALV\.?\b"),
    ("JUNCAO", r"\bJUNCAO\b|\bJUNC\.?\b"),
    ("UNIAO", r"\bUNIAO\b"),
    ("FLANGE", r"\bFLANGE\b"),
    ("CONDULETE", r"\bCONDULETE\b"),
    ("TAMPA", r"\bTAMPA\b"),
    ("SIFAO", r"\bSIFAO\b"),
    ("RALO", r"\bRALO\b"),
    ("GRELHA", r"\bGRELHA\b"),
    ("ENGATE", r"\bENGATE\b"),
    ("COLAR", r"\bCOLAR\b"),
    ("PROLONGAMENTO", r"\bPROLONGAMENTO\b"),
    ("TORNEIRA", r"\bTORNEIRA\b"),
    ("FITA", r"\bFITA\b"),
    ("ADESIVO", r"\bADESIVO\b|\bCOLA\b"),
    ("PASTA", r"\bPASTA\b"),
]

# Categories of a catalogue description.
CATALOGUE_CATEGORIES = [
    ("TUBO", r"\bTUBO\b"),
    ("JOELHO", r"\bJOELHO\b|\bCURVA\b"),
    ("TE", r"\bT[EÊ]\b"),
    ("LUVA", r"\bLUVA\b"),
    ("CAP", r"\bCAPA?\b"),
    ("ADAPTADOR", r"\bADAPTADOR\b"),
    ("BUCHA", r"\bBUCHA\b"),
    ("REGISTRO", r"\bREGISTRO\b"),
    ("VALVULA", r"\bV[ÁA]LVULA\b"),
    ("FLANGE", r"\bFLANGE\b"),
    ("UNIAO", r"\bUNI[AÃ]O\b"),
    ("TAMPA", r"\bTAMPA\b"),
    ("PASTA LUBRIFICANTE", r"\bPASTA LUBRIFICANTE\b|\bLUBRIFICANTE\b"),
    ("ADESIVO", r"\bADESIVO\b|\bCOLA\b"),
    ("REDUCAO", r"\bREDU[CÇ][AÃ]O\b"),
]

# Types of an alias name.
ALIAS_TYPES = [
    ("QUADRO", r"\bQUADRO\b"), ("PROLONGAMENTO", r"\bPROLONGAMENTO\b"),
    ("RALO", r"\bRALO\b"), ("CAIXA", r"\bCAIXA\b|\bCX\.?\b"),
    ("ELETRODUTO", r"\bELETROD|\bCORRUG"), ("JUNCAO", r"\bJUNCAO\b|\bJUNC\b"),
    ("BUCHA", r"\bBUCHA\b"), ("REGISTRO", r"\bREGISTRO\b|\bREG\."),
    ("UNIAO", r"\bUNIAO\b"), ("ADAPTADOR", r"\bADAPTADOR\b|\bADAPT\."),
    ("TUBO", r"\bTUBO\b"), ("JOELHO", r"\bJOELHO\b"), ("CURVA", r"\bCURVA\b"),
    ("TE", r"\bTE\b"), ("LUVA", r"\bLUVA\b"), ("CAP", r"\bCAP\b"),
    ("SIFAO", r"\bSIFAO\b|\bSIF\b"), ("VALVULA", r"\bVALVULA\b|\bVALV\b"),
    ("TERMINAL", r"\bTERMINAL\b"), ("COLAR", r"\bCOLAR\b"),
    ("ADESIVO", r"\bADESIVO\b|\bADESI\b"), ("FITA", r"\bFITA\b"),
    ("TORNEIRA", r"\bTORNEIRA\b|\bTORN\."), ("ENGATE", r"\bENGATE\b"),
    ("ASSENTO", r"\bASSENTO\b"), ("LAVATORIO", r"\bLAVATORIO\b"),
    ("REDUCAO", r"\bREDUCAO\b|\bRED\.?\s"),
]

# Categories of the vector stage: first in the list wins.
VECTOR_CATEGORIES = [
    ("TUBO", r"\bTUBO\b"), ("JOELHO", r"\bJOELHO\b|\bCURVA\b"), ("TE", r"\bT[EÊ]\b"),
    ("LUVA", r"\bLUVA\b"), ("CAP", r"\bCAP\b"), ("REDUCAO", r"\bREDU[CÇ]"),
    ("ADAPTADOR", r"\bADAPTADOR\b"), ("BUCHA", r"\bBUCHA\b"),
    ("REGISTRO", r"\bREGISTRO\b"), ("VALVULA", r"\bVALVULA\b"),
    ("JUNCAO", r"\bJUN[CÇ][AÃ]O\b"), ("UNIAO", r"\bUNI[AÃ]O\b"),
    ("FLANGE", r"\bFLANGE\b"), ("GRELHA", r"\bGRELHA\b"),
    ("ADESIVO", r"\bADESIVO\b|\bCOLA\b"), ("PASTA", r"\bPASTA\b"),
    ("FITA", r"\bFITA\b"), ("TORNEIRA", r"\bTORNEIRA\b"),
]

ALIAS_TYPE_CATEGORY = {t: t for t in [
    "TUBO", "JOELHO", "TE", "LUVA", "CAP", "REDUCAO", "BUCHA", "ADAPTADOR", "REGISTRO", "VALVULA", "JUNCAO",
    "FLANGE", "UNIAO", "QUADRO", "CAIXA", "ELETRODUTO", "TORNEIRA", "FITA", "ENGATE", "COLAR", "PROLONGAMENTO",
    "RALO", "SIFAO", "ASSENTO", "LAVATORIO", "ADESIVO",
]} | {"CURVA": "JOELHO"}

# Words that make a text an accessory when they come before TUBO.
ACCESSORY = (r"\b(?:LUVA|JOELHO|CURVA|TE|CAP|CAPA|BUCHA|ADAPTADOR|UNIAO|JUNCAO|REGISTRO|VALVULA"
             r"|FLANGE|TAMPA|(?:MULTI)?SIFAO|TESOURA|QUADRO|CAIXA)\b")

ANGLES = (45, 90, 180)
ELBOWS = ("JOELHO", "CURVA")
TWO_MEASURE_CATEGORIES = ("TE", "REDUCAO", "BUCHA", "LUVA", "ADAPTADOR", "JUNCAO", "JOELHO", "CURVA")

# Product types of the client price table stage.
PRODUCT_TYPES = [
    "TUBO", "CAP", "JOELHO", "CURVA", "TE", "LUVA", "REDUCAO", "ADAPTADOR", "BUCHA", "REGISTRO", "VALVULA", "FITA",
    "TORNEIRA", "ADESIVO", "COLA", "PASTA", "FLANGE", "UNIAO", "JUNCAO", "ANEL", "BOCAL", "SIFAO", "RALO", "CAIXA",
    "TAMPA", "GRELHA", "SOLUCAO", "CONEXAO", "ESPUMA",
]

UNIT_CLASSES = {
    "UNIDADE": ["UN", "UND", "UNID", "UNIDADE", "PC", "PÇ", "PEC", "PECA", "PEÇA", "PCS"],
    "METRO": ["M", "MT", "MTR", "METRO", "METROS"],
    "BARRA": ["BAR", "BR", "BARRA", "BARRAS", "BRS"],
    "CAIXA": ["CX", "CXA", "CX.", "CAIXA", "CAIXAS"],
    "ROLO": ["RL", "RLO", "ROLO", "ROLOS"],
    "KG": ["KG", "KGS", "QUILO", "QUILOS", "QUILOGRAMA"],
    "LITRO": ["L", "LT", "LTS", "LITRO", "LITROS"],
}
UNIT_NAMES = {"PÇ": "PC", "PCS": "PC", "PÇS": "PC", "UNID": "UN", "UND": "UN", "MT": "M",
              "M²": "M2", "M³": "M3"}

COMPANY_SUFFIXES = [r"\bLTDA\.?\b", r"\bS\.A\.?\b", r"\bSA\b", r"\bEIRELI\b", r"\bSPE\b",
                    r"\bME\b", r"\bEPP\b", r"\bS/A\b"]

# Match types that approve a line without review.
APPROVED_MATCH_TYPES = ["MATCH_CODIGO_MRV", "MATCH_CODIGO_BRASAL", "MATCH_FORTE", "MATCH_BOM",
                        "MATCH_FRACO", "MATCH_DESCRICAO", "MATCH_DESCRICAO_REVISAR"]

BLOCKED_CODES = ["784", "1758", "1759", "1761"]

# Words that never identify a product family, and accepted synonyms.
GENERIC_WORDS = [
    "PARA", "COM", "SEM", "POR", "DOS", "DAS", "DE", "DA", "DO", "EM", "TIPO", "SERIE", "COR", "REF", "PECA",
    "MATERIAL", "CANO", "AGUA", "ESGOTO", "PVC", "PPR", "CPVC", "ACO", "SOLD", "SOLDAVEL", "ROSCA", "ROSCAVEL",
    "RIGIDO", "RIGIDA", "FLEXIVEL", "LEVE", "PESADO", "NORMAL", "BRANCO", "PRETO", "CINZA", "AMARELO", "AZUL",
    "VERDE", "VERMELHO", "MARROM", "INCOLOR", "CONEXAO",
]
WORD_SYNONYMS = {"BORRACHA": "VEDACAO", "VEDACAO": "BORRACHA",
                 "SANITARIO": "ESGOTO", "ESGOTO": "SANITARIO"}

# Plug gauges in the order they are looked for, and the product of each.
PLUG_ORDER = ["1.1/2", "1.1/4", "3/4", "1/2", "2", "1"]
PLUG_CODES = {"1/2": "293", "3/4": "294", "1": "295", "1.1/2": "296", "1.1/4": "297", "2": "298"}
