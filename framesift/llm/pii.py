"""Personal data by weak supervision, with DataFrame functions alone.

Candidates are what the base patterns match, what a failing match has swallowed (a phone number before an address, a card between other
numbers), and what looser patterns match beside them. Four labelers vote yes, no or nothing on
each: format (is the strict form met), gazetteer (top-level domains, card issuers, country codes, address ranges), context (words
before the candidate) and shape (how its digits are grouped). The votes are counted over all documents; expectation-maximisation
on these counts estimates each labeler's reliability for each kind, and the posteriors train the final classifier, a logistic
score over the votes, the length and the neighbours of the span. The votes and features make one small code a candidate, so the
counts, and the accepted codes, are few however many documents there are. Base spans always stay; others are added where the
classifier is sure and they overlap none.

The patterns are possessive and anchored where this changes no match, so that long runs of letters or digits take linear time and
no recursion. Null text: empty, no spans. Null doc_id: kept. Repeated rows: a row each. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table, whole

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, written so that they find the same leftmost matches without backtracking.
BASE = {
    "email": f"(?:(?<![{LOCAL}])|\\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: What might be personal data beside that: spelled-out addresses, IPv6, cards grouped by dots, numbers without a country code.
LOOSE = {
    "email": f"(?<![{LOCAL}])[A-Za-z0-9][{LOCAL}]{{0,63}}+ ?(?:[\\[(](?:at|AT)[\\])]| (?:at|AT) (?=[A-Za-z0-9-]{{1,63}}(?: dot | DOT |[\\[( ]))) ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\\.|[\\[(](?:dot|DOT)[\\])]|(?<= )(?:dot|DOT)(?= )) ?[A-Za-z0-9-]{{1,63}}+){{1,5}}+",
    "ip": "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    "card": "(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9.])",
    "phone": "(?<![0-9A-Za-z+().-])(?:\\([0-9]{3}\\) ?|[0-9]{3}[.-]|00[1-9][0-9]{0,2}[ .-]\\(?[0-9]{2,4}\\)?[ .-])[0-9]{3}[ .-][0-9]{3,4}(?![0-9A-Za-z.-]*[0-9])",
}
#: What a failing base match may hold.
INNER = {
    "card": "(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\\2[0-9]{5})(?![0-9])",
    "phone": "\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{2,4}\\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])",
}
NEEDS = {"email": ("@", None), "phone": ("+", None)}  # a base match holds this
# Fixed lists of the gazetteer labeler.
TOP_DOMAINS = (
    "com org net edu gov mil int info biz name pro mobi app dev io ai co me tv cc xyz online site tech store shop blog cloud example test local "
    "ac ad ae af al am ar at au az ba bd be bg bh bo br by ca ch cl cn cr cu cy cz de dk do dz ec ee eg es et eu fi fr ge gh gr gt hk hn hr hu id ie il in iq ir is it "
    "jm jo jp ke kr kw kz lb lk lt lu lv ma md mk mm mt mx my ng ni nl no np nz om pa pe ph pk pl pr ps pt py qa ro rs ru sa se sg si sk su sv sy th tn tr tw ua ug uk us uy uz ve vn za"
).split()
ISSUERS = "^(?:4|5[0-8]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[689]|352[89]|35[3-8]|6011|62|64[4-9]|65|67)"
COUNTRY = "^(?:\\+|00)(?:1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9])"
RESERVED = "^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\\."
CONTEXT_YES = "(?i)(?:e-?mail|mail to|contact|write|reach|phone|tel|call|mobile|fax|card|visa|credit|payment|ip|host|server|address|from|user)\\W*(?:\\w+\\W*){0,2}$"
CONTEXT_NO = "(?i)(?:version|release|build|isbn|issn|order|invoice|serial|chapter|section|page|figure|doi)\\W*$"
LABELERS = 4


def found(text: Column, pattern: str, gate: str | None = None) -> Column:
    """array<struct<start, end, s>> of all matches, in code points: lengths of matches and of what lies between, added up."""
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    rows = F.aggregate(
        F.arrays_zip(match.alias("m"), F.slice(between, 1, F.size(match)).alias("b")),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["b"])).alias("start"), (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), x["m"].alias("s"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    has = F.regexp_like(text, F.lit(pattern))
    return F.when((F.contains(text, F.lit(gate)) & has) if gate else has, rows).otherwise(none)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    d = digits(s)
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + _doubled(F.substring(d, n - i + 1, F.lit(1)).cast("int"), i % 2 == 0),
    )
    return total % 10 == 0


def _doubled(x: Column, twice: Column) -> Column:
    return F.when(~twice, x).when(x < 5, x * 2).otherwise(x * 2 - 9)


def strict(kind: str, s: Column) -> Column:
    """Whether a match of the base pattern passes."""
    if kind == "ip":
        return F.forall(F.split(s, "\\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    n = F.length(digits(s))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(s)).otherwise(False)
    return (n >= 10) & (n <= 15) if kind == "phone" else F.lit(True)


def _gazetteer(kind: str, s: Column) -> Column:
    d = digits(s)
    if kind == "email":
        return F.lower(F.regexp_extract(s, "([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS)
    if kind == "ip":
        return F.contains(s, F.lit(":")) | ~s.rlike(RESERVED)
    if kind == "card":
        return d.rlike(ISSUERS)
    return s.rlike(COUNTRY) | (~s.startswith("+") & d.rlike("^[2-9]"))


def _shape(kind: str, s: Column) -> Column:
    n = F.length(digits(s))
    if kind == "email":
        return F.length(s).between(6, 80) & ~s.rlike("\\.\\.|^[.]|@.*@")
    if kind == "ip":
        return F.contains(s, F.lit(":")) | ~s.rlike("(^|\\.)0[0-9]")
    if kind == "card":
        return s.rlike("^[0-9]{4}([ ._/-]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{2,7}$") | s.rlike("^3[47][0-9]{2}([ -]?)[0-9]{6}\\1[0-9]{5}$")
    return n.between(10, 15) & ~s.rlike("[ .-]{3}|\\([^)]*$|[0-9]{13}")


def _vote(yes: Column, no: Column | None = None) -> Column:
    """2: yes, 0: no, 1: no vote."""
    return F.when(yes, 2).when(no, 1 if no is None else 0).otherwise(1) if no is not None else F.when(yes, 2).otherwise(0)


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `cands`: array<struct<start, kind, end, base, code>>."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs
    for kind in KINDS:
        out = out.withColumn(f"_b_{kind}", found(text, BASE[kind], NEEDS.get(kind, (None,))[0])).withColumn(f"_l_{kind}", found(text, LOOSE[kind]))

    def inner(kind: str):
        """What a failing match has swallowed; its text is empty if that is nothing."""
        at = lambda x: x["start"] + F.length(F.element_at(F.split(x["s"], INNER[kind], 2), 1))
        got = lambda x: F.regexp_extract(x["s"], INNER[kind], 0)
        failing = F.filter(F.col(f"_b_{kind}"), lambda x: (F.length(digits(x["s"])) >= 10) & ~strict(kind, x["s"]) & x["s"].rlike(INNER[kind]))
        return F.transform(failing, lambda x: F.struct(at(x).alias("start"), (at(x) + F.length(got(x))).alias("end"), got(x).alias("s")))

    def coded(k: int, base: bool, swallowed: bool = False):
        kind = KINDS[k]

        def one(x: Column) -> Column:
            s = x["s"]
            before = F.substring(text, F.greatest(x["start"] - 29, F.lit(1)), F.least(x["start"], F.lit(30)))
            after = F.substring(text, x["end"] + 1, F.lit(1))
            ok = strict(kind, s) if base else F.lit(False)
            digit = [
                F.lit(k),
                F.lit(int(base)),
                F.when(ok, 2).otherwise(0) if base else F.when(strict(kind, s), 2).otherwise(0) if swallowed or kind == "card" else F.lit(1),
                F.when(_gazetteer(kind, s), 2).otherwise(0),
                F.when(before.rlike(CONTEXT_YES), 2).when(before.rlike(CONTEXT_NO), 0).otherwise(1),
                F.when(_shape(kind, s), 2).otherwise(0),
                F.least(F.floor(F.length(s) / 8), F.lit(3)).cast("int"),
                F.when(before.rlike("(^|[\\s(<\\[:,;])$"), 0).otherwise(1),
                F.when(after.rlike("^[\\p{L}0-9_@]"), 1).otherwise(0),
            ]
            code = F.lit(0)
            for d, radix in zip(digit, RADIX, strict=True):
                code = code * radix + d
            return F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), ok.alias("base"), code.alias("code"))

        return one

    lists = [F.transform(F.col(f"_b_{kind}"), coded(k, True)) for k, kind in enumerate(KINDS)] + [F.transform(F.col(f"_l_{kind}"), coded(k, False)) for k, kind in enumerate(KINDS)]
    lists += [F.transform(inner(kind), coded(k, False, True)) for k, kind in enumerate(KINDS) if kind in INNER]
    return out.withColumn("cands", F.concat(*lists)).drop(*[f"_{x}_{kind}" for x in "bl" for kind in KINDS])


#: Radix of each digit of a code: kind, base pattern; the votes; length, character before, character after.
RADIX = (4, 2, 3, 3, 3, 3, 4, 2, 2)


def decode(code: int) -> list[int]:
    out = []
    for radix in reversed(RADIX):
        out.append(code % radix)
        code //= radix
    return out[::-1]


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], dict]:
    """EM over the counts of codes: the posterior of each code, and P(vote | truth) by (kind, labeler)."""
    codes = [(c, n, decode(c)) for c, n in sorted(counts.items())]
    post = {c: (sum(v == 2 for v in d[2:6]) + 0.5) / (sum(v != 1 for v in d[2:6]) + 1) for c, _, d in codes}
    like: dict = {}
    for _ in range(rounds):
        prior: dict = defaultdict(lambda: [1.0, 1.0])
        like = defaultdict(lambda: [[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]])
        for (k, j) in ((k, j) for k in range(len(KINDS)) for j in range(LABELERS)):
            like[k, j] = [[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]]  # a labeler is rather right than wrong
        for c, n, d in codes:
            for truth, w in ((1, n * post[c]), (0, n * (1 - post[c]))):
                prior[d[0]][truth] += w
                for j in range(LABELERS):
                    like[d[0], j][truth][d[2 + j]] += w
        new = {}
        for c, _, d in codes:
            odds = math.log(prior[d[0]][1] / prior[d[0]][0])
            for j in range(LABELERS):
                no, yes = like[d[0], j]
                odds += math.log(yes[d[2 + j]] / sum(yes)) - math.log(no[d[2 + j]] / sum(no))
            new[c] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        moved = max((abs(new[c] - post[c]) for c in new), default=0)
        post = new
        if moved < 1e-9:
            break
    return post, dict(like)


def train(counts: dict[int, int], rounds: int = 300, rate: float = 0.5) -> dict[int, float]:
    """The final classifier's probability of each code: logistic regression by kind on the posteriors, weighted by the counts."""
    post, _ = reliabilities(counts)
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        rows = [(c, n, [(i, v) for i, v in enumerate(decode(c)) if i > 1]) for c, n in sorted(counts.items()) if decode(c)[0] == kind]
        total = sum(n for _, n, _ in rows)
        weights: dict = defaultdict(float)
        for _ in range(rounds):
            grad: dict = defaultdict(float)
            for c, n, f in rows:
                e = (post[c] - 1 / (1 + math.exp(-(weights["bias"] + sum(weights[x] for x in f))))) * n / total
                grad["bias"] += e
                for x in f:
                    grad[x] += e
            for x, g in grad.items():
                weights[x] += rate * (g - 1e-4 * weights[x])
        for c, _, f in rows:
            out[c] = 1 / (1 + math.exp(-(weights["bias"] + sum(weights[x] for x in f))))
    return out


def accepted(docs: DataFrame, sure: float = 0.9) -> list[int]:
    """Codes of looser candidates that the classifier accepts; the counts are at most one row for each code."""
    counts = candidates(docs.select("text")).select(F.explode("cands").alias("c")).groupBy("c.code").count().collect()
    scores = train({r["code"]: r["count"] for r in counts})
    return sorted(c for c, p in scores.items() if p >= sure and decode(c)[1] == 0)


def spans(docs: DataFrame, codes: list[int]) -> DataFrame:
    """docs with `spans`: array<struct<start, kind, end>>, by start, then kind, and `base`, those of the base patterns."""
    out = candidates(docs).withColumn("base", F.array_sort(F.transform(F.filter("cands", lambda x: x["base"]), _plain)))
    more = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if codes:
        added = F.filter("cands", lambda x: ~x["base"] & x["code"].isin(codes) & ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
        wider = lambda x: F.exists(added, lambda y: (y["kind"] == x["kind"]) & (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"]))
        more = F.transform(F.filter(added, lambda x: ~wider(x)), _plain)
    return out.withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", more)))).drop("cands")


def _plain(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))


def of_kind(k: int):
    """For F.filter, which passes a function's second argument, even one with a default, the place in the list."""
    return lambda x: x["kind"] == k


def joined(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(column), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, codes: list[int]) -> DataFrame:
    """docs with each span in text replaced by its kind in angle brackets; overlapping spans by that of the first. Columns of any name pass
    through."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("text")
    built = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(
            x["start"] >= acc["at"],
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    found_ = spans(docs.select(whole(docs), "text"), codes)
    return found_.select(*parts(docs, text=F.when(F.size("spans") > 0, built).otherwise(text)))


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found_ = spans(docs, accepted(docs))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found_.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
