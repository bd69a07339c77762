"""The operators' registered queries: each applies one to its whole table and returns the full result."""

from __future__ import annotations

from . import (
    decontaminate,
    embedding_join,
    html_text,
    language,
    licenses,
    line_dedup,
    lm_score,
    near_dedup,
    pack,
    prefix_trie,
    secrets,
    shard,
    whitening,
)
from .common import read


def queries():
    return {
        "op1_decontaminate": lambda s, d: decontaminate.digest(read(s, d, "documents"), read(s, d, "benchmark")),
        "op2_pack": lambda s, d: pack.pack(read(s, d, "documents")),
        "op3_html_text": lambda s, d: html_text.extract(read(s, d, "pages")),
        "op4_hilbert_shards": lambda s, d: shard.shard(read(s, d, "documents")),
        "op5_language": lambda s, d: language.identify(read(s, d, "documents")),
        "op6_minhash_dedup": lambda s, d: near_dedup.near_duplicates(read(s, d, "documents")),
        "op7_licenses": lambda s, d: licenses.digest(read(s, d, "documents")),
        "op8_secrets": lambda s, d: secrets.digest(read(s, d, "documents")),
        "op9_embedding_dedup": lambda s, d: embedding_join.near_vectors(read(s, d, "embeddings")),
        "op10_lm_score": lambda s, d: lm_score.score(read(s, d, "documents")),
        "op11_line_dedup": lambda s, d: line_dedup.digest(read(s, d, "documents")),
        "op12_whitening": lambda s, d: whitening.whitened(read(s, d, "embeddings")),
        "op13_prefix_trie": lambda s, d: prefix_trie.prefix_trie(read(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op6_minhash_dedup": near_dedup.ORACLE,
        "op7_licenses": licenses.ORACLE,
        "op9_embedding_dedup": embedding_join.ORACLE,
        "op11_line_dedup": line_dedup.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
