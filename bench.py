"""Bench: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit",
"queries": {name: seconds}, "sf"}. Each query is run to completion with a
full-width aggregate over its output (no sampling), after one warm-up job.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quillmark.plans.catalog import QUERIES  # noqa: E402
from quillmark.session import local_session  # noqa: E402

HEADLINE = [
    "rouge_n", "rouge_n_lead", "rouge_l", "rouge_lsum", "rouge_stemmed", "bleu", "bleu_corpus",
    "meteor", "chrf", "embedding_match", "mover_score", "answer_coverage", "cloze_gain_lead",
    "lm_perplexity", "idf_table", "repeat_ngram_rate", "build_vocab", "encode_truncate_pad",
    "assemble_transcript", "turn_challenges", "metric_error_correlation", "challenge_error_link",
    "leaderboard", "learned_score",
]


def consume(df) -> int:
    """Materialise every row and column (hash of all values), return row count."""
    cols = [F.xxhash64(*[F.col(c) for c in df.columns]).alias("h")]
    r = df.select(*cols).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("s")).first()
    return int(r["n"])


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus, app="quillmark-bench")
    consume(QUERIES["rouge_n"](spark, sf_dir))   # warm-up: JIT, Python workers
    times, rows = {}, {}
    for n in names:
        t0 = time.time()
        rows[n] = consume(QUERIES[n](spark, sf_dir))
        times[n] = round(time.time() - t0, 3)
        print(f"# {n}: {times[n]}s rows={rows[n]}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows": rows,
                      "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
