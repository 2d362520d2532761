"""Small tables for the operators' tests."""

from __future__ import annotations

import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that have names of the operators' own, and of their working columns.
CLASHES = ["score", "n_words", "spans", "key", "row", "uid", "host", "kept", "_key", "md5", "size", "taken", "fp", "label", "start", "ids"]

SYLLABLES = {
    "en": "the th and ing ed ly er tion ou sh wh re".split(),
    "de": "der die und ung sch keit ein lich ver zu ach ge".split(),
    "fr": "le de et que tion ment eau eux é ai ou re".split(),
    "es": "el de la que ción ado os ar ll ñ mente ía".split(),
}


def prose(rng: random.Random, lang: str, words: int) -> str:
    out = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in out)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text: str | None) -> list[str]:
    return words((text or "").translate({c: c + 32 for c in range(65, 91)}))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose in four languages with copies, near copies, shared passages, nulls,
    blanks, short texts and one very long text."""
    rng = random.Random(seed)
    rows: list[tuple] = []
    passage = prose(rng, "en", 70)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randint(20, 200))
        if i % 7 == 3:
            text = f"{text} {passage} {prose(rng, lang, 15)}"
        rows.append((i, text, lang, f"s{i % 3}" if i % 11 else None, len(text)))
    base = rows[5][1].split(" ")
    for k in range(6):  # near copies
        edited = list(base)
        edited[(k * 17) % len(edited)] = f"edit{k}"
        rows.append((100 + k, " ".join(edited), rows[5][2], "s0", None))
    rows += [(200 + k, rows[9][1], rows[9][2], "s1", None) for k in range(4)]  # copies
    rows += [(300, None, None, "s0", None), (301, "", "en", "s0", 0), (302, " \t\n ", "en", None, 4), (303, "one", "en", "s2", 3)]
    rows += [(304, "123 456 !!", None, "s2", 10), (305, "a b c d", "en", "s2", 7), (None, "no id here but words enough to count", "en", "s1", None)]
    rows += [(306, "word " * 300, "en", "s1", None), (306, "word " * 300, "en", "s1", None)]  # a repeated row
    rows.append((307, prose(rng, "de", 20_000), "de", "s1", None))
    return rows


def frame(spark, rows: list[tuple], clashes: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df


def saved(df, folder, labels=None) -> str:
    """The frame as the tables of a data folder."""
    df.write.parquet(f"{folder}/documents.parquet")
    if labels is not None:
        labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)
