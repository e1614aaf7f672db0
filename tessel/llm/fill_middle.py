"""Fill-in-the-middle: texts cut at token bounds into prefix, middle and suffix, and put together in another order.

A pandas UDF gets Arrow batches of ids and texts. The regex library's finditer gives the tokens, whose end offsets go into a
compact array (four bytes a token, no token is kept); where the cuts lie is decided by a digest of the id, so two lookups
there slice the text, and reruns and other partitions agree. Each output is parsed back into its text.

Null and empty texts are plain, of no tokens, and their output is empty; texts that hold a marker are plain, as their
output could not be parsed; a very long text is cut whole in its row's task; a null id is digested as an empty one; repeated
rows get the same cuts; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import documents, text_only

TOKEN = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts of a hundred that are not left plain, and of those the ones that begin with their suffix.
CUT_PERCENT, SPM_PERCENT = 90, 20
#: Put before an id; another one gives other cuts.
SEED = "1"
RESULT = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string"


def draws(doc_id: str, seed: str = SEED) -> list[int]:
    """Four unsigned numbers of 32 bits from the digest of an id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def ends(text: str, pattern: regex.Pattern) -> array:
    """End offset of each token."""
    return array("Q" if len(text) >= 1 << 32 else "I", (m.end() for m in pattern.finditer(text)))


def transformed(doc_id: str, text: str, pattern: regex.Pattern, seed: str = SEED) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, characters of prefix and middle, and output of a text."""
    end = ends(text, pattern)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= CUT_PERCENT or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return len(end), "plain", None, None, text
    low, high = sorted((h1 % (len(end) + 1), h2 % (len(end) + 1)))
    a, b = (end[i - 1] if i else 0 for i in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_PERCENT:
        return len(end), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(end), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text of an output: no part holds a marker, so the first one after a part ends it."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at, last = output.index(second, len(first)), output.index(MIDDLE, len(first))
    one, two, middle = output[len(first) : at], output[at + len(second) : last], output[last + len(MIDDLE) :]
    return (two + middle + one) if form == "spm" else (one + middle + two)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transformer(keep: bool, seed: str) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(RESULT)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern, out = regex.compile(TOKEN), []
        for doc_id, text in zip(ids, texts, strict=True):
            n, form, prefix, middle, output = transformed(doc_id, text, pattern, seed)
            out.append((n, form, prefix, middle, digest(output), digest(restored(output, form)), output if keep else None))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")], dtype=object)
        return frame.astype({"n": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return cut


def fill_in_middle(docs: DataFrame, keep: bool = True, seed: str = SEED) -> DataFrame:
    """doc_id, tokens, form, cuts, digests of the output and of the text rebuilt from it, and with `keep` the output."""
    made = transformer(keep, seed)(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))
    out = text_only(docs).select("doc_id", made.alias("made")).select("doc_id", "made.*")
    return out if keep else out.drop("output")


def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle(documents(spark, sf_dir), keep=False)


OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '(?s){TOKEN}') AS w, {", ".join(f"CAST('0x' || h[{8 * i + 1}:{8 * i + 8}] AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {CUT_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
