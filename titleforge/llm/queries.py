"""The queries of the subpackage, with production parameters over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from titleforge.llm import chatfmt, decontam, hostrank, langid, linededup, mixing, quality, simhash, toxicity, warc
from titleforge.llm.common import read_table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: read_table(s, d, "documents")
    return {
        "op1_language_id": lambda s, d: langid.identified(docs(s, d)),
        "op2_line_dedup": lambda s, d: linededup.deduped(docs(s, d)),
        "op3_mixing": lambda s, d: mixing.sampled(docs(s, d)),
        "op4_quality": lambda s, d: quality.graded(docs(s, d), read_table(s, d, "labels")),
        "op5_warc": lambda s, d: warc.written(read_table(s, d, "pages")),
        "op6_simhash_dedup": lambda s, d: simhash.groups(docs(s, d)),
        "op7_url_filter": lambda s, d: hostrank.filter_urls(read_table(s, d, "pages")),
        "op8_toxicity": lambda s, d: toxicity.flagged(docs(s, d), read_table(s, d, "labels")),
        "op9_decontamination": lambda s, d: decontam.decontaminated(docs(s, d), read_table(s, d, "benchmark")),
        "op10_chat_format": lambda s, d: chatfmt.format_chats(read_table(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.ORACLE_SQL, "op9_decontamination": decontam.ORACLE_SQL, "op10_chat_format": chatfmt.ORACLE_SQL}
