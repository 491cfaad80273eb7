"""Line dedup against a brute-force edit join."""

import random

import pytest

pytest.importorskip("textvec.llm")


def keys(seed):
    """Lines among which are one group of near copies, chains of single edits, insertions and deletions, and others."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz "
    base = "the quick brown fox jumps over the lazy dog and runs away"
    out = []
    for _ in range(1200):  # one group of near copies
        at, kind = rng.randrange(len(base)), rng.randrange(3)
        out.append(base[:at] + ("", rng.choice(letters), rng.choice(letters))[kind] + base[at + (kind < 2) :])
    for i in range(300):  # a word of a common line is another one
        out.append("this common line has the word " + "".join(rng.choice(letters[:6]) for _ in range(rng.randrange(2, 7))) + " somewhere inside of it")
    for _ in range(6):  # chains, each link one edit from the one before
        word = "".join(rng.choice(letters) for _ in range(33)).strip() + "xxxxx"
        for _ in range(60):
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + ("" if len(word) > 34 else "q", rng.choice(letters), rng.choice(letters))[kind] + word[at + (kind < 2) :]
            out.append(word)
    out += [x + y for x in ("a" * 34, "ab" * 17, "a" * 33) for y in ("", "a", "b", "ab", "ba")]
    out += ["äöü ß Größe " * 3 + c for c in "äöüx"] + ["İstanbul " * 4 + c for c in ("", "a", "İ")]
    rng.shuffle(out)
    return [x for x in out if "\n" not in x]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


@pytest.mark.parametrize("small", [8, 2])
def test_near_copies_and_chains(spark, monkeypatch, small):
    from textvec.llm import line_dedup as ld

    monkeypatch.setattr(ld, "SMALL", small)
    monkeypatch.setattr(ld, "BROADCAST", 0 if small == 2 else 1 << 20)
    lines = keys(small)
    rows = [(i // 7, "\n".join(lines[i : i + 7])) for i in range(0, len(lines), 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.text for r in ld.line_dedup(df).collect()}
    norm = [(i, t, df_key) for i, (t, df_key) in enumerate((x, x.strip(" ").lower()) for x in lines)]
    first = {}
    for i, _, k in norm:
        if len(k) >= 20:
            first.setdefault(k, i)
    long = sorted((i, k) for k, i in first.items() if len(k) >= 32)
    near = {j for n, (j, b) in enumerate(long) if any(one_edit(a, b) for _, a in long[:n])}
    assert len(near) > 1000 and any(k not in near for k in first.values())
    keep = [len(k) < 20 or (first[k] == i and i not in near) for i, _, k in norm]
    want = {d: "\n".join(t for (i, t, _), ok in zip(norm, keep) if ok and i // 7 == d) for d, _ in rows}
    assert found == want


def test_clashing_columns_and_null_ids(spark):
    from textvec.llm.line_dedup import line_dedup

    line = "this line is long enough to take part in all of it"
    rows = [(1, line, 7, "a", "b"), (2, line, 8, "c", "d"), (None, line, 9, "e", "f"), (2, line, 8, "c", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, __kept string, __id string")
    out = line_dedup(df)
    assert sorted(out.columns) == sorted([*df.columns, "n_dropped"])
    assert sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_dropped, r["__kept"], r["__id"]) for r in out.collect())) == [(0, line, 1, 0, "e", "f"), (1, line, 1, 0, "a", "b"), (2, "", 1, 1, "c", "d"), (2, "", 1, 1, "c", "d")]
    assert {r.doc_id: r.n_dropped for r in line_dedup(df, edits=0).collect()} == {1: 0, 2: 1, None: 0}
    with pytest.raises(ValueError):
        line_dedup(df, edits=2)
