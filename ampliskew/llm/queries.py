"""Registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .contamination import OP4_SQL, contamination
from .html_text import extract_text
from .licenses import DOC_PATH, OP5_SQL, scan_licenses
from .lines import OP8_SQL, drop_lines
from .merkle import OP13_SQL, manifest
from .ngram_join import OP12_SQL, ngram_join
from .pieces import piece_digests, piece_tokens
from .quality import quality_rules
from .simhash import near_duplicates
from .spelling import OP11_SQL, spelling_variants
from .token_files import read_token_files, token_digests, token_files
from .urls import OP2_SQL, RULES, SPAM, host_of, judge_urls
from .warc import OP9_SQL, read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_html_text")
def op1_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


@query("op2_url_filter", OP2_SQL)
def op2_url_filter(spark, sf_dir):
    """Listed are the URLs of sites with spam words in their host."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, pages.where(host_of(F.col("url")).rlike(SPAM)), RULES)


@query("op3_quality_rules")
def op3_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_decontamination", OP4_SQL)
def op4_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query("op5_license_scan", OP5_SQL)
def op5_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(DOC_PATH).alias("path"))
    return scan_licenses(docs, id_col="doc_id")


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_pieces")
def op7_pieces(spark, sf_dir):
    return piece_digests(piece_tokens(table(spark, sf_dir, "documents"), PIECES))


@query("op8_line_dedup", OP8_SQL)
def op8_line_dedup(spark, sf_dir):
    return drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@query("op9_warc", OP9_SQL)
def op9_warc(spark, sf_dir):
    folder = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(spark, folder).withColumnRenamed("id", "page_id")


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    folder = token_files(table(spark, sf_dir, "documents"), BYTES)
    return token_digests(read_token_files(spark, folder))


@query("op11_spelling_variants", OP11_SQL)
def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"), one_in=199)


@query("op12_ngram_join", OP12_SQL)
def op12_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))[0]
