"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers

from . import byte_bpe, sanitisation, telephony, token_alignment
from .common import read_table, written
from .exact_dedup import ORACLE_SQL as EXACT_DEDUP_SQL
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .lexical_search import ORACLE_SQL as SEARCH_SQL
from .lexical_search import lexical_search
from .license_scan import license_scan
from .license_scan import oracle_sql as license_sql
from .packing import pack_documents
from .quality import quality
from .secret_scan import digests, secret_scan
from .simple8b import write_and_read
from .toxicity import toxicity
from .word_tokens import read_model


def op1_toxicity(spark, sf_dir):
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_license_scan(spark, sf_dir):
    return license_scan(read_table(spark, sf_dir, "documents")).drop("places")


def op4_telephony(spark, sf_dir):
    stored = written(telephony.store(read_table(spark, sf_dir, "documents")), "media")
    return telephony.decode(stored)  # with the resampled PCM, which is stored where the result is


def op5_quality(spark, sf_dir):
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"), read_model(public_tokenizers.path("word_bpe_49k.json"))).drop("ids")


def op8_secret_scan(spark, sf_dir):
    return digests(secret_scan(read_table(spark, sf_dir, "documents")))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("row")


def op10_simple8b(spark, sf_dir):
    return write_and_read(read_table(spark, sf_dir, "documents"), read_model(public_tokenizers.path("word_bpe_49k.json")))


def op11_lexical_search(spark, sf_dir):
    return lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_sanitisation(spark, sf_dir):
    return sanitisation.digests(sanitisation.Scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).spans())


def op13_token_alignment(spark, sf_dir):
    first = token_alignment.byte_level_model(public_tokenizers.path("byte_bpe_50k.json"))
    second = token_alignment.piece_model(public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.token_alignment(spark, read_table(spark, sf_dir, "documents"), first, second, public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_byte_bpe, op3_license_scan, op4_telephony, op5_quality, op6_jaccard_join, op7_packing, op8_secret_scan, op9_exact_dedup, op10_simple8b, op11_lexical_search, op12_sanitisation, op13_token_alignment)}
ORACLES = {"op3_license_scan": license_sql(), "op9_exact_dedup": EXACT_DEDUP_SQL, "op11_lexical_search": SEARCH_SQL}
