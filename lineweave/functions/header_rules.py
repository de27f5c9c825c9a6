"""Fixed values of header extraction: labels, patterns and markers of each document family.

A rule is (field, pattern, group, section).  Rules of one field are tried in the order given, each over the whole document;
``section`` names a block between two markers that the match must start in.  Patterns see a line and the one below it.
"""

from .rules import SUPPLIER

MINIMUM_CONFIDENCE = 0.60

# (family, markers that must all be on the first page): the first that fits decides
FAMILY_MARKERS = [
    ("SIENGE", ["sienge"]),
    ("SIENGE", ["starian"]),
    ("UAU", ["uau! software"]),
    ("UAU", ["gerou o.c."]),
    ("BRASAL", [f"{SUPPLIER}/{SUPPLIER}".lower()]),
    ("BRASAL", ["processo nº"]),
    ("MRV", ["ncm", "item nº"]),
    ("MRV", ["ncm", "item no"]),
    ("PAVINI", ["dados da ordem de compra", "responsavel pela compra"]),
    ("PAVINI", ["pavini", "obra/centro de custo"]),
]

# labels of table cells: field, labels in order of preference
CELL_LABELS = [
    ("number", ["pedido", "cotação", "numero"]),
    ("date", ["data do pedido", "data de envio", "data"]),
    ("total", ["total do pedido", "total dos insumos", "total da cotação"]),
    ("terms", ["cond. pagamento"]),
    ("name", ["nome"]),
    ("address", ["endereço"]),
    ("tax_id", ["cnpj", "cnpj/cpf"]),
    ("state_id", ["ie"]),
    ("phone", ["telefone"]),
    ("email", ["e-mail", "email"]),
    ("site", ["obra"]),
    ("delivery", ["local entrega", "local de entrega"]),
    ("person", ["contato"]),
    ("is_quote", ["cotação", "cotacao"]),
]

EMAIL = r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
STATES = "PR|SP|GO|RJ|MG|BA|RS|SC|DF|MT|MS"

UAU_RULES = [
    ("number", r"(?i)O\.C\.\s*[:\-]?\s*(\d+)", 1, None),
    ("number", r"(?i)COT\.\s*[:\-]?\s*(\d+)", 1, None),
    ("number", r"(?i)ORDEM DE COMPRA[:\s]+(\d+)", 1, None),
    ("number", r"(?i)PEDIDO[:\s]+(\d+)", 1, None),
    ("date", r"(?i)DATA[:\s]+(\d{2}/\d{2}/\d{4})", 1, None),
    ("date", r"(\d{2}/\d{2}/\d{4})", 1, None),
    ("is_quote", r"(?i)COTAC|COT\.", 0, None),
    ("name", r"(?iu)(?:EMPRESA|CLIENTE|RAZÃO SOCIAL)[:\s]+([A-Z][^\n]{5,80})", 1, None),
    ("tax_id", r"(?i)CNPJ[:\s/]*(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})", 1, None),
    ("phone", r"(?i)(?:FONE|TEL|TELEFONE)[:\s]*([(\d][^\n]{6,20})", 1, None),
    ("email", EMAIL, 1, None),
    ("address", r"(?iu)(?:ENDEREÇO|ENDERECO)[:\s]+([^\n]{10,120})", 1, None),
    ("site", r"(?i)OBRA[:\s]+([^\n]{5,100})", 1, None),
    ("site", r"(?i)EMPREENDIMENTO[:\s]+([^\n]{5,100})", 1, None),
    ("delivery", r"(?i)(?:LOCAL|ENTREGA)[:\s]+([^\n]{10,150})", 1, None),
]

CITY_OF_INVOICE = rf"(?i)(CURITIBA|[A-Z][A-Z\s]{{3,30}})\s*-\s*({STATES})\s*-?\s*CEP[:\s]*([\d.\-]{{8,10}})"
CITY_OF_DELIVERY = rf"(?i)([A-Z][a-zA-Z\s]+)\s*-\s*({STATES})\s*-\s*BR"
MRV_PAGES = 2
MRV_DEFAULT_TERMS = "30 dias"
MRV_INVOICE_EMAIL = "nfeletronicas@mrv.com.br"
MRV_RULES = [
    ("number", r"(?iu)N[oº°]\s*Pedido\s*de\s*Compra[:\s]*(\d+)", 1, None),
    ("date", r"(\d{2}\.\d{2}\.\d{4})\s*/00:00:00", 1, None),
    ("terms", r"(?i)(\d+)\s*dias\s*,com", 1, None),
    ("total", r"(?i)TOTAL GERAL[:\s]*([\d.,]+)", 1, None),
    ("name", r"MRV\s+([A-Z]{2,15}\s+[A-Z]{2,20})", 0, None),
    ("tax_id", r"CNPJ[:\s]*(\d{11,14})", 1, None),
    ("state_id", r"I\.E[:\s]*(\d{8,12})", 1, None),
    ("address", r"(?i)(RUA|AVENIDA|AV)\.?[^\n]{5,80}BATEL", 0, None),
    ("city", CITY_OF_INVOICE, 1, None),
    ("state", CITY_OF_INVOICE, 2, None),
    ("postcode", CITY_OF_INVOICE, 3, None),
    ("site", r"(?m)^([A-Z]+\s+EMP\s+\d+)$", 1, None),
    ("residence", r"(?i)GALPAO\s*-\s*([^\n]{5,60})", 1, None),
    ("delivery", r"(?i)LOCAL DE ENTREGA[:\s]*\n([^\n]{5,100})", 1, None),
    ("site_city", CITY_OF_DELIVERY, 1, None),
    ("site_state", CITY_OF_DELIVERY, 2, None),
    ("site_postcode", r"(\d{8})\s*-\s*\d{11,12}\s*-\s*Recebedor", 1, None),
    ("person", r"Contato:\s*([A-Z][A-Za-z]+)\s*/\s*([\d\s]+)", 1, None),
    ("person_phone", r"Contato:\s*([A-Z][A-Za-z]+)\s*/\s*([\d\s]+)", 2, None),
]

# block: (section, first marker, marker that ends it)
SECTIONS = {
    "BRASAL": [("invoice", "DADOS PARA FATURAMENTO", "DADOS PARA COBRAN"), ("supplier", "DADOS DO FORNECEDOR", "DADOS PARA FATURAMENTO"), ("delivery", "DADOS PARA ENTREGA", "AUTORIZAMOS")],
    "PAVINI": [("invoice", "DADOS DO FATURAMENTO", None), ("delivery", "ENDERE[CÇ]O ENTREGA", "Recebedor|ENDEREÇO COBRANÇA")],
}
BLOCK_VALUE = r"\s*:?\s*([^\n:]{3,120})"
BRASAL_RULES = [
    ("number", r"(?iu)OC\s*N[oº°][:.]?\s*(\d+)", 1, None),
    ("number", r"(?iu)Processo\s*N[oº°][:.]?\s*(\d+)", 1, None),
    ("date", r"(?iu)Emiss[aã]o[:.]?\s*(\d{2}/\d{2}/\d{4})", 1, None),
    ("terms", r"(?i)Cond\.\s*Pagt[oa][:.]?\s*(\d+\s*dias?)", 1, None),
    ("total", r"(?i)Total\s*Pedido\s*\n\s*([\d.,]+)", 1, None),
    ("site", r"(?i)Centro\s*de\s*Custo[:.]?\s*([^\n]{3,80})", 1, None),
    ("site_code", r"(?im)(\d{4,6})\s*[-–]\s*(INC\s*\d+\s*[A-Z][^\n]{5,80}?)(?:\s+OC\s*N|\s*$)", 1, None),
    ("site_unit", r"(?im)(\d{4,6})\s*[-–]\s*(INC\s*\d+\s*[A-Z][^\n]{5,80}?)(?:\s+OC\s*N|\s*$)", 2, None),
    ("name", r"(?iu)Raz[aã]o\s+Social" + BLOCK_VALUE, 1, "invoice"),
    ("address", r"(?iu)Endere[cç]o" + BLOCK_VALUE, 1, "invoice"),
    ("tax_id", r"(?i)CNPJ" + BLOCK_VALUE, 1, "invoice"),
    ("state_id", r"(?i)I\.E\." + BLOCK_VALUE, 1, "invoice"),
    ("city", r"(?iu)Munic[ií]pio" + BLOCK_VALUE, 1, "invoice"),
    ("district", r"(?i)Bairro" + BLOCK_VALUE, 1, "invoice"),
    ("postcode", r"CEP\s*[:.]?\s*(\d{2}\.?\d{3}-\d{3})", 1, "invoice"),
    ("email", r"(?i)E-?Mail\s*:\s*(\S+@\S+)", 1, "invoice"),
    ("delivery", r"(?iu)Endere[cç]o" + BLOCK_VALUE, 1, "delivery"),
    ("buyer_email", r"(?i)E-mail:\s*(\S+@\S+)", 1, None),
    ("buyer", r"(?mu)^([A-Z][a-z]+(?: (?:de|da|do|e|[A-Z][a-z]+)){2,5})\s*$", 1, None),
    ("supplier_email", r"(?i)E-?Mail\s*:\s*(\S+@\S+)", 1, "supplier"),
    ("supplier_phone", r"(?i)(?:Celular|Comercial)\s*:\s*([(\d][^\-\n]{5,20})", 1, "supplier"),
]

PAVINI_CITY = r"([A-ZÀ-Úa-zà-ú]+(?:\s+[A-ZÀ-Úa-zà-ú]+){0,2}),\s*([A-Z]{2})\s*[-–,]?\s*(\d{5}-?\d{3})"
PAVINI_BUYER = "Compras Pavini"
PAVINI_OFFICE = "PAVINI SEROA - ENGENHARIA"
DELIVERY_SPAN = 300
PAVINI_RULES = [
    ("number", r"(?i)ORDEM DE COMPRA\s*(\d+)", 1, None),
    ("date", r"Data:\s*(\d{2}/\d{2}/\d{4})", 1, None),
    ("terms", r"Cond\.\s*pgto\.:\s*([^\n]{3,30})", 1, None),
    ("total", r"Total\s+([\d.]+,\d+)", 1, None),
    ("forecast", r"Previs[aã]o\s*da\s*entrega:\s*(\d{2}/\d{2}/\d{4})", 1, None),
    ("name", r"(?im)^Nome:\s*(SPE[^\n]{3,80})", 1, None),
    ("name", r"(?im)^Nome:\s*([^\n]{5,80})", 1, "invoice"),
    ("tax_id", r"CNPJ:\s*(\d{8,14})", 1, None),
    ("address", r"Endere[cç]o:\s*([^\n]{5,100})", 1, None),
    ("city", PAVINI_CITY, 1, None),
    ("state", PAVINI_CITY, 2, None),
    ("postcode", PAVINI_CITY, 3, None),
    ("site", r"(?i)OBRA/CENTRO DE CUSTO:\s*([^\n]+?)(?:\s+CNO|$)", 1, None),
    ("email", r"(?i)Email:\s*(\S+@\S+)", 1, None),
    ("office_email", r"(?i)([a-z]+@paviniconstrucao\.com\.br)", 1, None),
    ("seller", r"(?i)Vendedor:\s*([^\n]{3,60})", 1, None),
    ("phone", r"(\d{2}\s*\d{4}\s*[-–]\s*\d{4})", 1, None),
]

LINE_RULES = {"UAU": UAU_RULES, "MRV": MRV_RULES, "BRASAL": BRASAL_RULES, "PAVINI": PAVINI_RULES}

# fields that count as evidence, per family
EVIDENCE = {
    "SIENGE": ["number", "date", "name", "tax_id", "email", "phone", "address", "site"],
    "UAU": ["number", "date", "name", "tax_id", "email", "address", "site"],
    "MRV": ["number", "date", "name", "tax_id", "address", "site", "terms", "total"],
    "BRASAL": ["number", "date", "name", "tax_id", "address", "email", "site", "terms"],
    "PAVINI": ["number", "date", "name", "tax_id", "address", "site", "email", "terms"],
}

# pattern: characters that every match holds as they stand; a text without them isn't searched
NEEDED = {
    EMAIL: ["@"],
    CITY_OF_INVOICE: ["-"],
    CITY_OF_DELIVERY: ["-"],
    PAVINI_CITY: [","],
    r"(?i)O\.C\.\s*[:\-]?\s*(\d+)": ["."],
    r"(?i)COT\.\s*[:\-]?\s*(\d+)": ["."],
    r"(?i)DATA[:\s]+(\d{2}/\d{2}/\d{4})": ["/"],
    r"(\d{2}/\d{2}/\d{4})": ["/"],
    r"(?i)CNPJ[:\s/]*(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})": ["/", "-"],
    r"(\d{2}\.\d{2}\.\d{4})\s*/00:00:00": ["/00:00:00"],
    r"(?i)(\d+)\s*dias\s*,com": [","],
    r"MRV\s+([A-Z]{2,15}\s+[A-Z]{2,20})": ["MRV"],
    r"CNPJ[:\s]*(\d{11,14})": ["CNPJ"],
    r"I\.E[:\s]*(\d{8,12})": ["I.E"],
    r"(?m)^([A-Z]+\s+EMP\s+\d+)$": ["EMP"],
    r"(?i)GALPAO\s*-\s*([^\n]{5,60})": ["-"],
    r"(\d{8})\s*-\s*\d{11,12}\s*-\s*Recebedor": ["Recebedor"],
    r"Contato:\s*([A-Z][A-Za-z]+)\s*/\s*([\d\s]+)": ["Contato:", "/"],
    r"(?iu)Emiss[aã]o[:.]?\s*(\d{2}/\d{2}/\d{4})": ["/"],
    r"(?i)Cond\.\s*Pagt[oa][:.]?\s*(\d+\s*dias?)": ["."],
    r"CEP\s*[:.]?\s*(\d{2}\.?\d{3}-\d{3})": ["CEP", "-"],
    r"(?i)E-?Mail\s*:\s*(\S+@\S+)": ["@", ":"],
    r"(?i)E-mail:\s*(\S+@\S+)": ["@", "-", ":"],
    r"(?i)(?:Celular|Comercial)\s*:\s*([(\d][^\-\n]{5,20})": [":"],
    r"Data:\s*(\d{2}/\d{2}/\d{4})": ["Data:", "/"],
    r"Cond\.\s*pgto\.:\s*([^\n]{3,30})": ["pgto.:"],
    r"Total\s+([\d.]+,\d+)": ["Total", ","],
    r"Previs[aã]o\s*da\s*entrega:\s*(\d{2}/\d{2}/\d{4})": ["entrega:", "/"],
    r"(?im)^Nome:\s*(SPE[^\n]{3,80})": [":"],
    r"(?im)^Nome:\s*([^\n]{5,80})": [":"],
    r"CNPJ:\s*(\d{8,14})": ["CNPJ:"],
    r"Endere[cç]o:\s*([^\n]{5,100})": ["Endere"],
    r"(?i)OBRA/CENTRO DE CUSTO:\s*([^\n]+?)(?:\s+CNO|$)": ["/", ":"],
    r"(?i)Email:\s*(\S+@\S+)": ["@", ":"],
    r"(?i)([a-z]+@paviniconstrucao\.com\.br)": ["@", "."],
    r"(?i)Vendedor:\s*([^\n]{3,60})": [":"],
}
