from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    """A few common words between many rare ones."""
    return " ".join(f"w{min(int(r.paretovariate(0.8)), 400)}" if r.random() < 0.3 else f"word{r.randint(1, 3000)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source): copies, near-copies, shared passages, repeated lines, junk, empty texts, white space, other scripts, one long text."""
    r = random.Random(1)
    docs = [prose(r, r.randint(60, 300)) for _ in range(40)]
    base = prose(r, 250)
    docs += [base, base, base.replace(" w1 ", " zz ", 1), base.upper()]
    passage = prose(r, 80)
    docs += [prose(r, 50) + "\n" + passage + "\n" + prose(r, 50) for _ in range(6)]
    docs += [passage[:300] + passage[:300], "a" * 1500, "ab" * 900 + "x" + "ab" * 900, "", "   \n\t ", "word", "one two three four", "ÄÖ straße 日本語 " * 40]
    docs += ["Lorem ipsum dolor sit amet, consectetur adipiscing elit\n" * 3 + prose(r, 60), "Lorem ipsum dolor sit amet, consectetur adipiscing elif\n" + prose(r, 60)]
    docs += [" ".join(f"{w}***" for w in prose(r, 120).split()), "\n".join([prose(r, 6000), prose(r, 10)])]
    rows = [(i, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(docs)]
    return [*rows, (len(rows), None, "s1")]


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in corpus], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nasty(spark, tmp_path_factory):
    """Null keys, repeated rows, and columns of names that operators use themselves."""
    path = str(tmp_path_factory.mktemp("nasty") / "documents.parquet")
    extra = {n: "x" for n in ("row", "k", "t", "h", "_row", "_w", "fp", "key", "size", "n_words", "root", "copies", "ids", "score", "shard", "u", "host", "line", "gone", "entries", "mh", "token_ids", "kept_", "place", "cell")}
    text = "the same text stands here more than once, and it is long enough to be looked at " * 4
    rows = [(None, text), (None, None), (5, text), (5, text), (6, ""), (7, "  "), (None, text), (8, "short")]
    names = list(extra)
    spark.createDataFrame([(i, t, "en", None, 1, *extra.values()) for i, t in rows], SCHEMA + "".join(f", `{n}` string" for n in names)).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
