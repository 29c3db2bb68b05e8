import random

import pytest

from marginalia.llm import leakage


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(4)
    for _ in range(400):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, m))) for m in (90, 120))
        want = distance(p, t)
        assert leakage.myers(p, t, 1000) == want and leakage.myers(p, t, 5) == min(want, 6)
    assert leakage.myers("", "x", 2) == 0


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def edited(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "z" + text[i:], text[:i] + "z" + text[i + 1 :]])
    return text


def test_search_equals_brute_force():
    rng = random.Random(6)
    words = vocabulary(rng)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 30)))) for i in range(12)]
    items.append((12, items[0][1]))  # a passage twice
    items.append((13, None))
    needles = leakage.Needles(items)
    for _ in range(150):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(20)))]
        for _ in range(rng.randrange(3)):
            own = leakage.words(rng.choice(items[:12])[1])
            start, size = rng.randrange(len(own)), rng.randrange(6, 20)
            parts += [edited(rng, " ".join(own[start : start + size]), rng.randrange(4)), rng.choice(words)]
        text = " ".join(parts)
        line = " ".join(leakage.words(text))
        want = {}
        for item, passage in items:
            own = leakage.words(passage)
            for i in range(len(own) - leakage.WINDOW + 1):
                d = distance(" ".join(own[i : i + leakage.WINDOW]), line)
                if d <= leakage.BUDGET:
                    want[item] = min(want.get(item, 9), d)
        got = needles.search(text)
        # A distance of 0 must be at word borders; the brute force above may find it within longer words.
        assert set(got) == set(want)
        assert all(got[i] >= want[i] for i in got)


def test_edits_at_the_blanks_between_pieces_equal_brute_force():
    own = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    needles = leakage.Needles([(1, " ".join(own))])
    line = " ".join(own)
    blanks = [i for i, c in enumerate(line) if c == " "]
    joined = [line[:i] + line[i + 1 :] for i in blanks]
    split = [line[:i] + " " + line[i:] for i in range(1, len(line)) if " " not in line[i - 1 : i + 1]]
    typos = [*joined, *split]
    typos += [t[:i] + t[i + 1 :] for t in joined for i, c in enumerate(t) if c == " "]  # two blanks gone
    typos += [t[:i] + "e" + t[i + 1 :] for t in joined for i in range(0, len(t), 3) if t[i] != " "]
    typos.append(line.replace("delta epsilon", "deltaepsilon").replace("kappa", "kappe"))
    for text in typos:
        want = distance(line, text)
        assert want <= 2 and needles.search(text) == {1: want}, text


def test_every_one_and_two_edit_damage_is_found():
    own = "one fine day the oldest cat of our street sat still there".split()
    needles = leakage.Needles([(1, " ".join(own))])
    line = " ".join(own)
    cuts = [line[:i] + line[i + 1 :] for i in range(len(line))]
    glued = [line[:i] + "q" + line[i:] for i in range(len(line) + 1)]
    for once in [*cuts, *glued]:
        for text in [once, f"so {once} now", *[once[:i] + once[i + 1 :] for i in range(0, len(once), 2)], *[once[:i] + "x" + once[i:] for i in range(1, len(once), 3)]]:
            clean = " ".join(leakage.words(text))
            want = distance(line, clean)
            got = needles.search(text)
            # A word of two letters that both go takes a blank with it: three edits of the line.
            assert got in (({1: want}, {1: max(1, want)}) if want <= 2 else ({},)), text


def test_automata_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(leakage, "_BUILT", {})
    items = lambda i: type("B", (), {"value": [(i, " ".join(f"w{i}x{k}" for k in range(14)))]})()
    for i in range(9):
        leakage._needles(str(i), items(i), 12, 2)
    assert list(leakage._BUILT) == ["5", "6", "7", "8"]
    kept = leakage._BUILT["6"]
    assert leakage._needles("6", None, 12, 2) is kept and list(leakage._BUILT)[-1] == "6"


def test_words_within_longer_words_are_not_distance_0():
    own = "the index of the second shop holds every document that was rendered".split()
    needles = leakage.Needles([(1, " ".join(own))])
    assert needles.search(" ".join(own)) == {1: 0}
    assert needles.search("x " + " ".join(own)[:-1] + "ds y") == {1: 1}
    assert needles.search(" ".join(own) + "s") == needles.search("ba" + " ".join(own)) == {1: 1}
    assert needles.search(" ".join(own) + "s " + " ".join(own)) == {1: 0}


def test_words():
    assert leakage.words("Don't_stop  Übung-3x, 日本 ²a") == ["don", "t", "stop", "übung", "3x", "日本", "²a"]
    assert leakage.words(None) == leakage.words(" .,") == []
    with pytest.raises(ValueError):
        leakage.Needles([], window=2, budget=2)


def test_dataframe(spark, monkeypatch):
    passage = " ".join(f"word{i}" for i in range(20))
    docs = [(1, f"x {passage.upper()}. y"), (1, f"x {passage.upper()}. y"), (2, " ".join(passage.split()[3:15])), (3, " ".join(passage.split()[3:14])), (4, None), (5, ""), (6, passage.replace("word9", "wort9")), (None, passage), (7, "z " * 200_000 + passage)]
    items = [(1, passage), (2, passage), (2, passage), (3, None), (4, "too short"), (None, passage)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "9 AS item_id", "'p' AS passage")
    di = spark.createDataFrame(items, "item_id bigint, passage string").selectExpr("*", "1 AS doc_id")
    want = {(1, 1, 0), (2, 1, 0), (6, 1, 1), (None, 1, 0), (7, 1, 0)} | {(1, 2, 0), (2, 2, 0), (6, 2, 1), (None, 2, 0), (7, 2, 0)}
    assert {tuple(r) for r in leakage.leaks(df, di).collect()} == want
    for name, most in (("BLOCK_CHARACTERS", 1), ("ITEM_CHARACTERS", 200)):  # several automata in one reading, several readings
        monkeypatch.setattr(leakage, name, most)
        assert {tuple(r) for r in leakage.leaks(df, di).collect()} == want
    assert leakage.leaks(df.limit(0), di).count() == 0 and leakage.leaks(df, di.limit(0)).count() == 0
