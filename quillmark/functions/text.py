"""Column-level text functions (all JVM-side, codegen-friendly).

Every function here takes and returns ``Column`` objects so Catalyst can
fold them into the surrounding projection; nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ROUGE-style word tokeniser: lower-case, anything outside [a-z0-9] is a
# separator.
ROUGE_SEPARATOR = r"[^a-z0-9]+"
# BLEU 13a tokeniser, the four substitutions in the order they apply. Its first class
# has the space too; more spaces beside a space change no token, so it is left out.
BLEU_13A_RULES = [
    (r"([\{-\~\[-\`\!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


# White space as Python's str.strip() takes it (fixed values).
WHITE_SPACE = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_empty(arr: Column) -> Column:
    return F.filter(arr, lambda t: t != F.lit(""))


def tok(c) -> Column:
    """ROUGE tokeniser: lower -> split on runs of non-alphanumerics -> drop empties
    (one regex pass; same tokens as replacing the runs by spaces first)."""
    return F.array_remove(F.split(F.lower(_col(c)), ROUGE_SEPARATOR), "")


def tok13a(c) -> Column:
    """BLEU 13a tokeniser (case-sensitive)."""
    s = F.concat(F.lit(" "), F.replace(_col(c), F.lit("\n"), F.lit(" ")), F.lit(" "))
    for pattern, repl in BLEU_13A_RULES:
        s = F.regexp_replace(s, pattern, repl)
    return F.array_remove(F.split(s, " "), "")


def strip_text(c) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace of any kind."""
    return F.regexp_replace(_col(c), rf"^{WHITE_SPACE}+|{WHITE_SPACE}+\z", "")


def split_sentences_naive(c) -> Column:
    """``text.split('. ')``."""
    return F.split(_col(c), r"\. ")


def join_sentences_naive(arr) -> Column:
    """Inverse of :func:`split_sentences_naive`: ``'. '.join(parts)``."""
    return F.array_join(_col(arr), ". ")


def sentence_lines(c) -> Column:
    """One sentence per line: a newline after every ``.``, ``!`` or ``?``
    followed by whitespace (rule form of a sentence tokeniser)."""
    return F.regexp_replace(_col(c), r"([.!?])\s+", "$1\n")


def no_whitespace(c) -> Column:
    """Text with all whitespace removed (chrF's character stream)."""
    return F.regexp_replace(_col(c), r"\s+", "")


def ngrams(tokens, n: int) -> Column:
    """Array of space-joined word n-grams of a token array (empty if too short).

    Pass a column reference, not an expression: the array is read inside a
    lambda, so an expression there would be re-evaluated per element.
    """
    t = _col(tokens)
    return F.when(F.size(t) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)),
                              lambda i: F.array_join(F.slice(t, i, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


def line_count(c) -> Column:
    """Number of newline characters in a text."""
    return F.length(_col(c)) - F.length(F.regexp_replace(_col(c), "\n", ""))


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0 when ``den`` is 0 (ANSI-safe)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def f_measure(p: Column, r: Column) -> Column:
    """Harmonic mean ``2pr/(p+r)``, 0 when ``p + r = 0``."""
    return F.when((p + r) == 0, F.lit(0.0)).otherwise(2.0 * p * r / (p + r))


def r6(c: Column) -> Column:
    """Round a score to 6 places at the query boundary."""
    return F.round(c.cast("double"), 6)
