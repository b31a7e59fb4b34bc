"""Word lists whose content must equal the reference's for equal routing results."""

from __future__ import annotations

# Abbreviations appended in full to a question (names of products are left out).
QUERY_ABBREVIATIONS = {
    "RCA": "representante comercial autonomo",
    "NF": "nota fiscal",
    "NFE": "nota fiscal eletronica",
    "NFC": "nota fiscal de consumidor",
    "FPU": "F P U",
    "MIQ": "M I Q",
    "MQT": "M Q T",
    "SQP": "sistema de quota e premio",
    "PDV": "ponto de venda",
    "SKU": "stock keeping unit",
    "WMS": "warehouse management system",
    "ATUALIZID": "controle de sincronizacao atualizid",
    "USAGRADE": "parametro usagrade de grade de produto",
    "PARAMFILIAL": "rotina paramfilial 132",
}

# Intents, most important first.
INTENT_PRIORITY = ["sql_lookup", "troubleshooting", "integration", "configuration", "process", "general"]

# Terms that mark how a passage answers, in the order in which they are tried.
ANSWER_MODE_TERMS = [
    ("troubleshooting", ["erro", "falha", "critica", "problema", "nao aparece", "nao sincroniza"]),
    ("sql_lookup", ["select ", " from ", " join ", " tabela", " campo", " coluna", " banco"]),
    ("configuration", ["parametro", "configuracao", "habilitar", "desabilitar", "permissao"]),
    ("integration", ["integracao", "endpoint", " api", " erp", "json", "extrator"]),
    ("process", ["pedido", "venda", "orcamento", "rota", "visita", "processo", "fluxo"]),
]
