"""The training-data queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, cross_tokenizer, embedding_dedup, exact_dedup, language_id, line_dedup, mixing, ngram_jaccard, packing, periodic_runs, quality, secrets, urls

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.op1_ngram_jaccard,
    "op2_language_id": language_id.op2_language_id,
    "op3_packing": packing.op3_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_chat_format": chat.op6_chat_format,
    "op7_url_filter": urls.op7_url_filter,
    "op8_quality": quality.op8_quality,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
    "op12_cross_tokenizer": cross_tokenizer.op12_cross_tokenizer,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
#: The others are not expressible in SQL; tests/llm holds them against plain Python or held-out labels.
ORACLE = {
    "op1_ngram_jaccard": ngram_jaccard.OP1_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
