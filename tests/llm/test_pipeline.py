"""The pipeline's stages against plain versions; the order of the mixture is kept to the end."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import xxhash
from conftest import sentence
from framesift.llm import mixing
from framesift.llm.common import cut


def test_sequences_follow_the_slots(spark, tmp_path):
    """Files of unlike lengths, which Spark reads longest first."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    rng = random.Random(3)
    rows = [(i, sentence(rng, 40 + i // 2), "en", ["hot", "s1", "s2"][min(i % 5, 2)], 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    try:
        got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.unset(key)
    kept = docs.join(spark.createDataFrame([(i,) for i in {r.doc_id for r in got}], "doc_id long"), "doc_id", "leftsemi")
    assert kept.count() > 200
    at = {r.doc_id: (r.slot, r.place) for r in mixing.mix(kept).collect()}
    tasks = defaultdict(list)
    for r in got:
        tasks[r.sequence_id >> 36].append(at[r.doc_id])
    assert len(tasks) > 1
    ranges = [(min(x), max(x)) for _, x in sorted(tasks.items())]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


ALPHABETS = {"en": "the and ing sho wor".split(), "de": "sch ung ein lich ück".split(), "es": "ción los que ñar mie".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randint(2, 4))) for _ in range(n))


def mixed_corpus():
    """(doc_id, text, lang, source, n_chars) and the ids whose language is none: mixtures of three, null and letterless texts."""
    rng = random.Random(31)
    texts, none = [], set()
    for i in range(240):
        lang = rng.choice(list(ALPHABETS))
        if i % 20 == 7:
            none.add(i)
            texts.append((" ".join(prose(rng, x, 60) for x in ALPHABETS), "en"))
        else:
            data = rng.choice(["", "", " mail ann.b@example.org now", " call +49 171 555 1234 9 today", " from 10.0.0.25 and 4111 1111 1111 1111 paid", " ip 10.0.0.256 and a@b,"])
            texts.append((prose(rng, lang, rng.choice([1, 4, 30, 90, 300])) + data, rng.choice([lang, lang, None])))
    base = prose(rng, "en", 200).split()
    for k in range(30):  # near copies: some alike enough, some not
        w = list(base)
        for j in range(k % 9):
            w[(23 * j + 7 * k) % len(w)] = f"edit{'abcdefghijklmnopqrstuvwxyzabcdef'[k]}"
        texts.append((" ".join(w), "en"))
    texts += [(" ".join(base), "en")] * 5 + [(" ".join(base).upper(), "en"), (prose(rng, "de", 9000), "de")]
    for t in (None, "", " \n\t", "123 456 !", "+1 (499) 555-6503"):
        none.add(len(texts))
        texts.append((t, None))
    rows = [(i, t, lang, None if i % 11 == 3 else "hot" if i % 3 == 0 else f"s{i % 7}", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    rows += [rows[0], rows[0], rows[250]]  # repeated rows
    rng.shuffle(rows)
    return rows, none


def redacted(t):
    out, at = [], 0
    for span in filter(None, brute.pii_base(t).split(",")):
        kind, start, end = span.split(":")
        if int(start) >= at:
            out += [t[at : int(start)], f"<{kind.upper()}>"]
        at = max(at, int(end))
    return "".join(out) + t[at:]


def fluid(left, weights, t):
    """Blocks of each source by slot t if all that have blocks left were placed at once, in proportion to their weights."""
    left, done = {s: float(n) for s, n in left.items()}, dict.fromkeys(left, 0.0)
    while t > 1e-9 and left:
        w = sum(weights[s] for s in left)
        step = min(t, min(n / weights[s] for s, n in left.items()) * w)
        for s in list(left):
            done[s] += step * weights[s] / w
            left[s] -= step * weights[s] / w
            if left[s] < 1e-9:
                del left[s]
        t -= step
    return done


def test_run_against_plain_stages(spark, tmp_path):
    """Every stage on what the one before it kept, and the rows of run(), against plain versions of all five."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, none = mixed_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    want = [r for r in rows if r[0] not in none]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        got = docs.collect()
        if name == "near_duplicates":
            ordered = sorted(want, key=lambda r: r[0])
            want = [r for i, (r, c) in enumerate(zip(ordered, brute.components([r[1] for r in ordered], 5, 80)[1], strict=True)) if i == c]
            assert len(want) < len(ordered) - 10
        if name == "personal_data":
            assert sum(redacted(r[1]) != r[1] for r in want) > 20
            want = [(r[0], redacted(r[1]), *r[2:4], len(redacted(r[1]))) for r in want]
        assert Counter(tuple(r[:5]) for r in got) == Counter(want), name
    # slots: sources within a block of their shares at each of them, each source in the order of its hash, 16 documents a block
    by_source = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.slot, r.place)):
        by_source[r.source].append(r)
    blocks = {s: -(-len(x) // 16) for s, x in by_source.items()}
    weights = {s: len(x) ** 0.5 for s, x in by_source.items()}
    for x in by_source.values():
        order = sorted(x, key=lambda r: int.from_bytes(xxhash.xxh64(r.doc_id.to_bytes(8, "little"), seed=42).digest(), "big", signed=True))
        assert [r.doc_id for r in x] == [r.doc_id for r in order]
        assert [r.place for r in x] == [i % 16 for i in range(len(x))]
    source_of = {r.slot: r.source for r in got}
    assert sorted(source_of) == list(range(sum(blocks.values())))
    seen = Counter()
    for t in sorted(source_of):
        seen[source_of[t]] += 1
        share = fluid(blocks, weights, t + 1)
        assert all(abs(seen[s] - share[s]) < 1 + 1e-6 for s in blocks)
    # pieces: all ids of each document, once, in windows without gaps
    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: [*enc.encode(r[1], add_special_tokens=False).ids, 0] for r in want}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.doc_id][r.start : r.start + r.length]))
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    tiled = lambda x: all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[0][0] == 0
    assert pieces.keys() == ids.keys()
    assert all(tiled(sorted(x)) and sum(n for _, n in x) == len(ids[d]) for d, x in pieces.items())
    assert all(tiled(sorted(x)) for x in windows.values())
    lengths = [sum(n for _, n in x) for x in windows.values()]
    assert all(n == 1024 or n & (n - 1) == 0 and n < 1024 for n in lengths)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
