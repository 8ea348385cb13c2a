"""Operators 11 to 13 against plain versions and their SQL."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from compare import differences, oracle
from framesift.llm import conversation_repair as repair
from framesift.llm import filter_audit, registry, url_rules
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SF).toPandas(), oracle(SF, registry.ORACLE_SQL[name])) == []


# 11


def plain_verdict(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h.count(".") + 1 if h else 0, len(p), v, h + p) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/e"), ("allow", "net", "/es/a/b"), ("allow", "net", ""),
    ("block", "a.net", "/x"), ("allow", "a.net", "/x"), ("allow", "org", "/long/way/to/the/page"), ("block", "", "/ads/"), ("block", "é.org", "/"), ("block", "com", "/a"), ("block", "com", "/ab"),
]
URLS = [
    "http://example.com/en/1", "https://www.example.com/en/", "https://WWW.Example.com/en/x?q=1", "http://b.www.example.com/en/x#y", "http://example.com", "http://notexample.com/en/", "http://x.net/es/a/b/c", "http://net/es",
    "http://x.net/english", "http://x.net", "http://a.net/xyz", "http://b.a.net/y", "http://x.org/long/way/to/the/page/2", "http://x.org/long/way/to/the/pag", "http://x.org/ads/1", "http://é.org/", "ÉÀ://É.org/É",
    "no scheme/en/", "", None, "://", "http:///es/", "http://com:80/", "http://x.com./", "http://com//a", "http://com/a", "http://com/abc/d", "http://.com/", "http://user@x.net/e\n/s", "x://y://example.com/en/", "http://" + "l." * 200 + "com/" + "s/" * 500,
]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_urls_against_a_plain_reading(spark, most):
    rng = random.Random(3)
    hosts, segments = ["com", "net", "a.net", "b.a.net", "www.example.com", "example.com", "org", "x"], ["", "e", "en", "es", "a", "b", "ab", "x"]
    urls = URLS + [f"http://{rng.choice(hosts)}{''.join('/' + rng.choice(segments) for _ in range(rng.randint(0, 4)))}" for _ in range(300)]
    rows = [(i, u, "h", "p", "r", "v") for i, u in enumerate(urls)] + [(None, "http://x.net/es/", *"abcd")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string").repartition(3)
    rules = RULES + [(rng.choice(["allow", "block"]), rng.choice(hosts), "".join("/" + rng.choice(segments) for _ in range(rng.randint(0, 3)))) for _ in range(40)]
    rules = [(max(v for v, *k in rules if k == [h, p]), h, p) for _, h, p in rules]
    table = spark.createDataFrame([*rules, (None, "com", "/"), ("block", None, "/ads/")], "verdict string, host string, path string")
    got = url_rules.judge(pages, table, "allow", most).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, rules, "allow"), r.url


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_urls_without_pages_or_rules(spark, most):
    pages = spark.createDataFrame([(1, "http://x.net/es/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [(r.rule, r.verdict) for r in url_rules.judge(pages, none, "block", most).collect()] == [(None, "block")]
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(RULES, none.schema), most_bytes=most).count() == 0


def test_one_url_may_fill_a_third_of_the_table(spark):
    pages = spark.range(30_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://x.net/es/").otherwise(F.concat(F.lit("http://a.com/"), "id")).alias("url"))
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")
    got = [{(r.verdict, r.rule): r["count"] for r in url_rules.judge(pages, rules, most_bytes=m).groupBy("verdict", "rule").count().collect()} for m in (1 << 20, 0)]
    assert got[0] == got[1] == {("block", "net/es/"): 10_000, ("allow", "com/"): 20_000}


# 12

NEXT = {0: "su", 1: "u", 2: "a", 3: "u"}
TO = {"s": 1, "u": 2, "a": 3}


def every_repair(turns, most):
    """All sequences of edits with at most `most` insertions between turns, tried one by one."""
    best = None
    gaps = [""] + ["".join(p) for n in range(1, most + 1) for p in itertools.product("ua", repeat=n)]
    for kinds in itertools.product(*[["D"] if t[1] else ["D", "K", "u", "a"] for t in turns]):
        for added in itertools.product(gaps, repeat=len(turns) + 1):
            roles, letters, cost = "", "", 0
            for t, k, g in zip([*turns, None], [*kinds, None], added, strict=True):
                roles, letters, cost = roles + g, letters + "I" * len(g), cost + 2 * len(g)
                if k:
                    letters += k if k in "DK" else "R"
                    roles += "" if k == "D" else (t[0] or "x") if k == "K" else k
                    cost += 3 if k == "D" else t[2] + 2 * (k != "K")
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, letters), (cost, letters))
    return best


def test_layers_against_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            turns = [(rng.choice("suua") if rng.random() < 0.8 else "", rng.random() < 0.3, rng.randint(0, 1)) for _ in range(n)]
            assert solved(turns)[:2] == every_repair(turns, 2)


def solved(turns):
    return repair.solve([repair.Item(repair.code(i, g, bool(t)), 0, i, "") for i, g, t in turns], 0, repair.END, True)


def test_layers_against_a_plain_table():
    rng = random.Random(6)
    for _ in range(1500):
        turns = [(rng.choice(["s", "u", "u", "a", "a", ""]), rng.random() < 0.2, int(rng.random() < 0.3)) for _ in range(rng.randint(0, 14))]
        cost, audit, left = solved(turns)
        assert (cost, audit) == least(turns)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in left))


def least(turns):
    """From the end: the least (cost, letters) of each state."""
    v = {q: ((0, "") if q in (0, 3) else (2, "I") if q == 2 else (4, "II")) for q in range(4)}
    add = lambda x, c, letter: (x[0] + c, letter + x[1])
    for initial, must_go, late in reversed(turns):
        w = {}
        for q in range(4):
            options = [add(v[q], 3, "D")]
            if not must_go:
                options += [add(v[TO.get(initial, 0)], late, "K")] * bool(initial and initial in NEXT[q])
                options += [add(v[TO[c]], 2 + late, "R") for c in NEXT[q].replace("s", "")]
            w[q] = min(options)
        for _ in range(3):
            w = {q: min([w[q]] + [add(w[TO[c]], 2, "I") for c in NEXT[q].replace("s", "")]) for q in range(4)}
        v = w
    return v[0]


def plain_row(rows, damaged):
    """The query's row of one conversation: rows (turn, role, text)."""
    out, seen, faults, turns = [], set(), Counter(), []
    for turn, role, text in sorted(damaged, key=lambda r: (r[0] is not None, r[0], r[1].encode(), hashlib.sha256(r[2].encode()).digest())):
        solid = text.rstrip(" \t\n\r\x0b\x0c")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        turns.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault in ("blank", "duplicate"), int(fault == "truncated")))
        out.append((role, text))
    cost, audit = least(turns)
    left, i = [], 0
    total = len(audit.replace("D", ""))
    for c in audit:
        expected = "user" if (total + len(left)) % 2 == 0 else "assistant"
        if c in "KRI":
            left.append(f"{out[i][0] if c == 'K' else expected}:{'' if c == 'I' else out[i][1]}")
        i += c != "I"
    known = [t for t, *_ in damaged if t is not None]
    initials = [r[:1] for r, _ in out]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, faults["blank"], faults["duplicate"], faults["truncated"],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest(),
    )


def plain_damage(conv, turn, role, text):
    name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    role, text = (" " if x is None else x for x in (role, text))
    kind = zlib.crc32(name.encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 12) if c else 700):  # the first conversation holds most rows
            role = ["user", "assistant"][t % 2] if rng.random() < 0.8 else rng.choice(["system", "user", "tool", "", None, "assistant"])
            text = rng.choice(["One.", "Two!", "three", " \t\n", "", None, "And more?  ", "é\u2003.", "x" * 3000 + "."]) if rng.random() < 0.3 else f"Text {c} {t}."
            rows.append((c if c != 7 else None, t if rng.random() < 0.95 else rng.choice([None, t + 5, -3]), role, text))
    rows += [(3, 2, "user", "Again and again.")] * 400 + [(61, None, None, None)] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [3, 4096])
def test_conversations_against_a_plain_repair(spark, talks, piece, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", piece)
    df = spark.createDataFrame([(*r, 1, 2) for r in talks], "conv_id long, turn long, role string, text string, copies long, first long").repartition(5)
    pieces = repair.repair(repair.damage(df))
    assert piece > 3 or pieces.where("conv_id = 0").count() > 200
    got = {r.conv_id: tuple(r)[1:] for r in repair.digest(pieces).collect()}
    by_conv = defaultdict(list)
    for r in talks:
        by_conv[r[0]].append(r)
    assert set(got) == set(by_conv)
    for c, rows in by_conv.items():
        assert got[c] == plain_row(rows, [x for r in rows for x in plain_damage(*r)]), c


def test_repaired_turns_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "And?"), (1, 2, "assistant", "Yes."), (2, 5, "system", "Be kind."), (2, 6, "assistant", "So I am.")]
    fine = spark.createDataFrame(rows, schema).withColumn("copies", F.lit(1))
    left = {c: [t for r in sorted((r for r in repair.repair(fine).collect() if r.conv_id == c), key=lambda r: (r.part, r.no)) for t in map(tuple, r.turns)] for c in (1, 2)}
    assert left[1] == [("user", "Hi."), ("assistant", ""), ("user", "And?"), ("assistant", "Yes.")]  # I before the K of the second, as cheap as R
    assert left[2] == [("system", "Be kind."), ("user", ""), ("assistant", "So I am.")]
    assert repair.digest(repair.repair(repair.damage(fine.limit(0)))).count() == 0
    gone = repair.digest(repair.repair(fine.withColumn("copies", F.lit(0)))).collect()
    assert sorted(map(tuple, gone)) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, 2)]


# 13


def plain_audit(docs, labels):
    least_id, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least_id[t or ""] = min(least_id.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least_id[t] < i}
        fails.append((lang or "", {k for k, v in f.items() if v}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                here = [x for x in mine if f in x[1] and not x[1] & set(order[: step - 1])]
                shapley[f] += len(here)
                out[part, order, step] = [
                    sum(not x[1] & set(order[:step]) for x in mine), len(here), sum(f in x[1] and bool(x[1] & set(order[: step - 1])) for x in mine), sum(x[1] == {f} for x in mine),
                    sum(x[2] for x in here), sum(x[3] for x in here),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_a_plain_one(spark, corpus):
    rows = [(r[0], r[1], r[2]) for r in corpus] + [(600 + i, "Copy # of it " * 50, "de") for i in range(300)] + [(7, "Copy # of it " * 50, "fr")] * 40
    rows += [(None, "Copy # of it " * 50, ""), (900, "a" * 6000, "en"), (901, "a" * 5999 + "b", "en"), (902, "a" * 5999 + "b", "en"), (903, "a" * 600 + "b" * 5400, "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 700, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, m long, mask int, part string").repartition(4)
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(rows, labels)
    assert len(got) == len(want) and {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_refinement_drops_singletons(spark):
    texts = ["same text", "same text", "sane text", "other", "a" * 100 + "x", "a" * 100 + "y", "a" * 5000, "a" * 5000]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = filter_audit.traits(docs)
    assert sorted(r.doc_id for r in filter_audit.refined(rows).collect()) == [0, 1, 6, 7]
    assert sorted(r.doc_id for r in filter_audit.copies(docs, rows).collect()) == [1, 7]


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
