"""The training-data queries and their oracles, for the entry point."""

from __future__ import annotations

from importlib import import_module

#: query name -> (module, function of the tables, tables it reads, module attribute with its SQL)
_QUERIES = {
    "op1_language_id": ("langid", "language_id", ("documents",), None),
    "op2_substring_dedup": ("substring_dedup", "substring_dedup", ("documents",), None),
    "op3_source_mixing": ("mixing", "source_mixing", ("documents",), "SQL"),
    "op6_simhash_near_dedup": ("simhash", "simhash_near_dedup", ("documents",), None),
    "op8_secret_scan": ("secrets", "secret_scan", ("documents",), None),
    "op5_benchmark_decontamination": ("decontamination", "benchmark_decontamination", ("documents", "benchmark"), None),
    "op4_document_fingerprints": ("imatch", "document_fingerprints", ("documents",), None),
    "op7_html_extraction": ("html_text", "html_extraction", ("pages",), None),
    "op9_url_filter": ("url_filter", "url_filter", ("pages",), None),
    "op10_warc_fixity": ("warc", "warc_fixity", ("pages",), "SQL"),
}


def _query(module: str, function: str, tables: tuple[str, ...]):
    def run(spark, sf_dir):
        from ferrule.llm.common import compact, release, table

        release(spark)  # what earlier queries held
        operator = getattr(import_module(f"ferrule.llm.{module}"), function)
        sources = [table(spark, sf_dir, t) for t in tables]
        return compact(operator(*sources), *sources)

    return run


def queries() -> dict:
    return {name: _query(*what[:3]) for name, what in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"ferrule.llm.{module}"), sql) for name, (module, _, _, sql) in _QUERIES.items() if sql}
