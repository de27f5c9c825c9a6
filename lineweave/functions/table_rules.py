"""Fixed values of table, catalogue and model-document extraction."""
from .rules import SUPPLIER

# cell texts (lower case) that name a column of an item table
ITEM_COLUMNS = {
    "idx": ["item"],
    "desc": ["descricao", "descrição", "description"],
    "unit": ["un.", "un", "und", "unidade"],
    "qty": ["qtde", "qtd", "qtd.", "quantidade"],
    "price": ["preco unit.", "preço unit.", "preco unitario", "preço unitário", "vl. unit.", "r$ unit.", "valor unitario"],
    "total": ["total", "vl. total", "r$ total", "valor total"],
}
ITEM_TABLE_HINTS = ["descricao", "descrição", "qtde", "qtd"]
REPEATED_HEADER_CELL = ["descrição", "descricao", "descriã§ã£o"]

# lines of a catalogue page that carry nothing, after accents are gone
CATALOGUE_NOISE = [
    "CATALOGO DE PRODUTOS",
    "EDICAO 01/2024",
    "AGUA FRIA",
    "AGUA QUENTE",
    "ESGOTO",
    "ESGOTO SERIE REFORCADA",
    "ELETRICA",
    "ACESSORIOS",
    "COD.",
    "BITOLA(MM)",
    "BITOLA(MM X POL.)",
    "BITOLA(MM X POL)",
    "BITOLA(POL.)",
    "BITOLA(DN)",
    "EMBAL.",
    "PRODUTO",
    "NUEVO",
]
CATALOGUE_NOISE_PARTS = ["VENTA MEDIANTE CONSULTA", "VENDA SOB CONSULTA"]
CATALOGUE_TITLE_WORDS = [
    "TUBO",
    "SOLDAVEL",
    "ROSCAVEL",
    "ADAPTADOR",
    "BUCHA",
    "LUVA",
    "CAP",
    "CURVA",
    "JOELHO",
    "TE",
    "UNIAO",
    "REGISTRO",
    "VALVULA",
    "REDUCAO",
    "TRANSICAO",
]
CATALOGUE_SECTIONS = [
    "AGUA FRIA",
    "AGUA QUENTE",
    "ESGOTO SERIE REFORCADA",
    "ESGOTO",
    "ELETRICA",
    "ACESSORIOS",
]
CATALOGUE_ROW = r"^(\d{3,4})\s+(.+?)\s+([\d./]+)$"

# documents on the model layout: code, description, quantity
MODEL_TITLE = rf"(?i)COD\s*(?:IGO)?\.?\s*(?:{SUPPLIER}|CLIENTE|CLI)\b"
MODEL_DESCRIPTION = r"(?i)descri"
MODEL_QUANTITY = r"(?i)quant|qtd|qnd"
MODEL_CODE_COLUMN = r"(?iu)^c[oó]d|\bcod\b|c[oó]digo"
MODEL_UNIT = r"(?i)^unid|\bun\.?$|\bunidade\b"
MODEL_HEADER_MARKS = ["código", "codigo", "descri", "quant", "qtd", "unidade", "unid"]
MODEL_UNITS = ["UN", "UND", "UNID", "PC", "PÇ", "PCS", "PÇS", "M", "MT", "M2", "M²", "M3", "M³", "BR", "CX", "KG", "G", "L", "ML", "JG", "PAR", "RL", "SC"]
NUMBER = r"^(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d{1,4})?$"
SHEET_HEADER_ROWS = 20
