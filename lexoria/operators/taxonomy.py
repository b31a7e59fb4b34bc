"""Classification of documents and sections: by rules over headings, or by editors' words.

A rule table is tried in order, once a section; the first rule that fits gives the module and leaves
its signal. Where an editor has classified a document, its sections inherit that, but for what is
overridden for a section, and every value is held against the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.functions.text import folded

VERSION = "taxonomy_v1"

# The vocabulary, and what its names were called before.
MODULES = ["configuracao", "pedidos_vendas", "logistica", "financeiro", "sql_integracao", "unknown"]
ANSWER_MODES = ["procedure", "configuration", "reference", "troubleshooting", "sql_lookup", "unknown"]
LEGACY_MODULE = {
    "configuracao": "parametros_configuracao", "pedidos_vendas": "pedidos_vendas", "logistica": "rotas_visitas_consultas",
    "financeiro": "financeiro_pagamentos", "sql_integracao": "sql_integracao", "unknown": "geral",
}
LEGACY_MODE = {
    "procedure": "process", "configuration": "configuration", "reference": "general",
    "troubleshooting": "troubleshooting", "sql_lookup": "sql_lookup", "unknown": "general",
}
MODULE_OF = {v: k for k, v in LEGACY_MODULE.items()} | {"campanhas_descontos": "pedidos_vendas", "suporte_processos": "unknown", "gestao_operacional": "unknown", "glossario": "unknown"}
MODE_OF = {"process": "procedure", "integration": "reference", "general": "unknown", "configuration": "configuration", "troubleshooting": "troubleshooting", "sql_lookup": "sql_lookup"}


@dataclass(frozen=True)
class Rule:
    """A signal for a module: words of the heading (a pattern over folded text), where ``only`` holds:
    ``any``, ``was_sql`` (the old module was SQL) or ``unknown`` (no module is known)."""

    signal: str
    module: str
    words: str
    only: str = "any"


# The rules in the order in which they are tried.
MODULE_RULES = [
    Rule("sql_heading", "sql_integracao", "sql|select|consulta sql", "was_sql"),
    Rule("parameter_configuration", "configuracao", "parametr[oa]s?|configurac(?:ao|oes)"),
    Rule("user_permission", "configuracao", "permissao|usuario|perfil de acesso"),
    Rule("finance", "financeiro", "conta corrente|pagamento|financeiro|boleto"),
    Rule("order_heading", "pedidos_vendas", "pedidos?|vendas?|orcamentos?|campanhas?|descontos?", "unknown"),
    Rule("logistics_heading", "logistica", "rotas?|visitas?|logistica|entregas?", "unknown"),
    Rule("sql_heading", "sql_integracao", "sql|select|tabela|banco de dados", "unknown"),
]
TROUBLE, PROCEDURE = "erro|falha|problema|nao sincroniza|nao aparece", "fluxo|passo a passo|procedimento"
#: Characters of a text that a parameter's table may decide by itself.
SHORT = 500


def _has(text: Column, words: str) -> Column:
    return text.rlike(rf"\b(?:{words})\b")


def _named(table: dict[str, str], name: Column, default: str | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), name)
    return found if default is None else F.coalesce(found, F.lit(default))


def heuristic(rows: DataFrame, parameter_table: str = "parametros?", title: str = "title", content: str = "content", module: str = "legacy_module", mode: str = "legacy_mode") -> DataFrame:
    """``rows`` with primary_module, secondary_modules, answer_mode, reason, signals, module and
    answer_mode under their old names (legacy_module_out, legacy_mode_out).

    ``parameter_table``: words that make a short text one about a parameter, wherever they stand. A
    module or mode that no rule changes keeps its old name as it was. Nulls count as empty texts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = rows.withColumn("_h", F.explode(F.array(folded(text(title)))))
    known = _named(MODULE_OF, F.col(module), "unknown")
    card = (F.length(text(content)) <= SHORT) & _has(folded(text(content)), parameter_table)
    only = {"any": F.lit(True), "was_sql": F.coalesce(F.col(module) == "sql_integracao", F.lit(False)), "unknown": known == "unknown"}
    first = None
    for rule in MODULE_RULES:
        fits = only[rule.only] & _has(F.col("_h"), rule.words)
        fits = fits | card if rule.signal == "parameter_configuration" else fits
        value = F.struct(F.lit(rule.signal).alias("signal"), F.lit(rule.module).alias("module"))
        first = F.when(fits, value) if first is None else first.when(fits, value)
    made = made.withColumn("_r", F.explode(F.array(first.otherwise(F.struct(F.lit("legacy_module").alias("signal"), known.alias("module"))))))
    signal, primary, heading = F.col("_r.signal"), F.col("_r.module"), F.col("_h")
    old_mode = _named(MODE_OF, F.col(mode), "unknown")
    about_parameters = (primary == "configuracao") & (_has(heading, MODULE_RULES[1].words) | card | (signal == "user_permission"))
    answer = (
        F.when(_has(heading, TROUBLE), "troubleshooting").when(_has(heading, MODULE_RULES[0].words) & (primary == "sql_integracao"), "sql_lookup")
        .when(about_parameters, "configuration").when(_has(heading, PROCEDURE), "procedure")
    )
    made = made.withColumn("_a", F.explode(F.array(answer)))
    answered = F.coalesce("_a", old_mode)
    secondary = F.when((primary == "configuracao") & _has(heading, MODULE_RULES[3].words), F.array(F.lit("financeiro"))).otherwise(F.array().cast("array<string>"))
    same = lambda changed, old, new, table: F.when(~changed & F.col(old).isNotNull(), F.col(old)).otherwise(_named(table, new))
    out = made.withColumn("primary_module", primary).withColumn("secondary_modules", secondary).withColumn("answer_mode", answered).withColumn("reason", F.lit("heuristic"))
    out = out.withColumn("signals", F.array_compact(F.array(signal, F.col("_a"))))
    out = out.withColumn("legacy_module_out", same(signal != "legacy_module", module, primary, LEGACY_MODULE)).withColumn("legacy_mode_out", same(answered != old_mode, mode, answered, LEGACY_MODE))
    return out.drop("_h", "_r", "_a")


_FIELDS = ("products", "primary_module", "secondary_modules", "answer_mode")


def editorial(rows: DataFrame, products: list[str], taxonomy: str = "taxonomy", override: str = "override") -> DataFrame:
    """``rows`` with primary_module, secondary_modules, answer_mode, products, reason, signals and
    problem. ``taxonomy`` and ``override`` are structs of the same fields, ``taxonomy`` also with
    taxonomy_version; a null of the override is inherited. signals are the overridden fields. problem
    names what is outside the vocabulary: version, module, answer_mode or product; null without."""
    value = lambda c: F.coalesce(F.col(f"{override}.{c}"), F.col(f"{taxonomy}.{c}"))
    listed = lambda c: F.coalesce(value(c), F.array().cast("array<string>"))
    out = rows.withColumn("primary_module", value("primary_module")).withColumn("secondary_modules", listed("secondary_modules")).withColumn("answer_mode", value("answer_mode")).withColumn("products", listed("products"))
    changed = F.array_compact(F.array(*[F.when(F.col(f"{override}.{c}").isNotNull(), c) for c in _FIELDS]))
    out = out.withColumn("signals", changed).withColumn("reason", F.when(F.size(changed) > 0, "editorial_override").otherwise("editorial_inheritance"))
    inside = lambda c, names: F.coalesce(F.col(c).isin(names), F.lit(False))
    all_in = lambda c, names: F.forall(c, lambda x: F.coalesce(x.isin(names), F.lit(False)))
    problem = (
        F.when(F.coalesce(F.col(f"{taxonomy}.taxonomy_version") != VERSION, F.lit(True)), "version").when(~inside("primary_module", MODULES) | ~all_in("secondary_modules", MODULES), "module")
        .when(~inside("answer_mode", ANSWER_MODES), "answer_mode").when(~all_in("products", products), "product")
    )
    return out.withColumn("problem", problem)


def classify_sections(sections: DataFrame, by_name: list[tuple[str, str]], by_word: list[tuple[str, str]], products: list[str], parameter_table: str = "parametros?") -> DataFrame:
    """Every section with its classification. sections: (doc_id, section_index, heading_path, content,
    base_module, taxonomy, overrides): sections whose document has a ``taxonomy`` get the editors' word,
    with the ``override`` of their own; the others are judged by their heading and text."""
    from .ingest import section_module
    from .routing import answer_mode

    own = sections.filter("taxonomy IS NULL")
    guessed = own.withColumn("legacy_module", section_module(F.col("base_module"), F.col("heading_path"), F.col("content"), by_name, by_word)).withColumn("legacy_mode", answer_mode(F.col("content"), F.col("heading_path")))
    columns = ["doc_id", "section_index", "primary_module", "secondary_modules", "answer_mode", "reason", "signals"]
    ruled = heuristic(guessed, parameter_table, title="heading_path").select(*columns, F.col("legacy_module_out").alias("module"), F.col("legacy_mode_out").alias("mode"), F.lit(None).cast("string").alias("problem"))
    named = editorial(sections.filter("taxonomy IS NOT NULL"), products)
    return ruled.unionByName(named.select(*columns, _named(LEGACY_MODULE, F.col("primary_module")).alias("module"), _named(LEGACY_MODE, F.col("answer_mode")).alias("mode"), "problem"))
