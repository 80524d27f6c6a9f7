from __future__ import annotations

from lotwise.llm import lines


def test_copies_of_short_lines_go(spark, tmp_path):
    path = str(tmp_path / "d")
    texts = [(1, "Menu\n\n  \nMenu\nx\nMenv"), (2, "Home\nMenu\n\n  \nx"), (3, None), (4, "a line of twenty and more characters\nHome\nHome ")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = {r.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in lines.dedup_lines(spark.read.parquet(path)).collect()}
    assert got == {
        1: ("Menu\n\n  \nx\nMenv", 6, 1, 0),
        2: ("Home\n\n  ", 5, 2, 0),
        3: (None, 0, 0, 0),
        4: ("a line of twenty and more characters\nHome ", 3, 1, 0),
    }


def test_keys_of_probes_alone_are_split(spark, tmp_path, monkeypatch):
    """Many lines with one head: keys that hardly an entry has, and very many probe.  No group holds them all, and nothing is lost."""
    import random

    r = random.Random(3)
    head = "the same beginning of all these lines, some dozens of characters of it "
    texts = [(i, "\n".join(head + "".join(r.choice("abcdefghij") for _ in range(r.randint(30, 60))) for _ in range(20))) for i in range(30)]
    last = texts[-1][1].split("\n")[0]
    texts.append((99, last + "x\n" + last[:-1] + "\n" + last))
    path = str(tmp_path / "d")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(2).write.parquet(path)
    want = {x.doc_id: x.text for x in lines.dedup_lines(spark.read.parquet(path)).collect()}
    assert want[99] == ""
    for name, value in (("HOT", 4), ("HOT_PROBES", 8), ("SAMPLED", 1)):
        monkeypatch.setattr(lines, name, value)
    assert {x.doc_id: x.text for x in lines.dedup_lines(spark.read.parquet(path)).collect()} == want
