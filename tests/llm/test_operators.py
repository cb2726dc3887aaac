"""Operators against brute force on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendlab.llm import bpe, chat, decontam, html, quality, shards, simhash, suffixes, toxicity, urls

SMALL = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use themselves.
CLASHES = ["h", "cell", "shard", "fp", "centre", "component_id", "key", "part", "stack", "n_words", "label", "payload", "group", "ids", "score"]


def texts_of(seed=1, n=60):
    """Invented texts with copies, near copies, shared passages and odd ones."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéßthr") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    make = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, out = make(40), []
    for k in range(n):
        kind = k % 6
        text = make(rnd.randint(1, 90))
        if kind == 1 and out:
            text = out[0]
        elif kind == 2 and out:
            split = rnd.choice(out).split()
            text = " ".join(w if rnd.random() > 0.04 else rnd.choice(words) for w in split)
        elif kind == 3:
            text = f"{make(20)} {passage}\n{make(20)}"
        out.append(text)
    return [*out, "", " \n\t", "x", "aaaa" * 60, "ab" * 120, "ab" * 130, make(20000), "nul\0byte " * 20]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, t) for k, t in enumerate(texts_of())]
    rows += [(1000, None), (1001, None), (None, "alone without an id and quite unlike the rest of them"), (7, rows[7][1]), (7, rows[7][1])]
    extra = [(i, t, "src", *[0] * len(CLASHES)) for i, t in rows]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in CLASHES)
    return spark.createDataFrame(extra, schema).repartition(5), rows


def as_rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# ------------------------------------------------------------------ sharding


def split_by_hand(rows, limit):
    coded = [(i, len((t or "").encode()), int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)) for i, t in rows]

    def split(held, depth):
        if sum(n for _, n, _ in held) <= limit or len({h for _, _, h in held}) == 1 or depth == 60:
            size = sum(n for _, n, _ in held)
            return [(i, n, format(held[0][2] >> (60 - depth), f"0{depth}b") if depth else "", depth, size, size > limit) for i, n, _ in held]
        halves = defaultdict(list)
        for row in held:
            halves[row[2] >> (59 - depth) & 1].append(row)
        return [x for half in halves.values() for x in split(half, depth + 1)]

    return sorted(split(coded, 0), key=repr)


@pytest.mark.parametrize(("limit", "bits"), [(1, 5), (500, 3), (3000, 12), (10**9, 12)])
def test_shards_split_only_what_is_too_large(documents, limit, bits):
    docs, rows = documents
    got = as_rows(shards.extendible_shards(docs, limit, bits), "doc_id", "n_bytes", "shard", "local_depth", "shard_bytes", "oversized")
    assert got == split_by_hand(rows, limit)


@pytest.mark.parametrize("bits", [3, 12])
def test_shards_part_rows_of_one_id(spark, bits):
    """A third of the rows without id, a third of one id, half of both with one text: every shard fits, but for a single text over the limit."""
    rows = [(i, "x" * (i % 50)) for i in range(60)]
    rows += [(key, "same text" if i % 2 else f"text {i}") for key in (None, 7) for i in range(60)] + [(7, "y" * 500), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shards.extendible_shards(docs, 100, bits, part_ids=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_bytes) for r in got), key=key) == sorted(((i, len(t or "")) for i, t in rows), key=key)
    sizes, holds = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
        holds.setdefault(r.shard, []).append(r)
    for name, members in holds.items():
        assert all(r.shard_bytes == sizes[name] and r.local_depth == len(name) and r.oversized == (sizes[name] > 100) for r in members)
        assert sizes[name] <= 100 or max(r.n_bytes for r in members) == sizes[name] == 500
        assert not any(other != name and other.startswith(name) for other in holds)
    assert sum(2.0 ** -len(name) for name in holds) <= 1


def test_shard_directory_is_complete(documents):
    entries = shards.directory(shards.extendible_shards(documents[0], 800)).collect()
    assert sum(e["n_entries"] for e in entries) <= 1 << entries[0]["global_depth"]
    assert sum(e["n_docs"] for e in entries) == len(documents[1])
    with pytest.raises(ValueError, match="positive"):
        shards.extendible_shards(documents[0], 0)


# ------------------------------------------------------------------ SimHash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(links, nodes):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_duplicates_equal_all_pairs(documents):
    docs, rows = documents
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in prints})
    links = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2]
    root = closed(links, distinct)
    least = defaultdict(lambda: None)
    for i, f in prints:
        if i is not None and (least[root[f]] is None or i < least[root[f]]):
            least[root[f]] = i
    want = sorted(((i, format(f, "016x"), least[root[f]]) for i, f in prints), key=repr)
    assert as_rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


def jaccard_by_hand(a, b):
    sets = []
    for text in (a, b):
        words = re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").strip("\x20\x09\x0a\x0b\x0c\x0d"))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def groups_by_hand(texts):
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard_by_hand(texts[a], texts[b]) >= 0.8]
    return closed(links, range(len(texts)))


def test_near_copies_equal_all_pairs(spark):
    rnd = random.Random(8)
    texts = ["", None, " \n", "a b", "A  b", "short text of six words here", "short text of six words there"]
    for _ in range(25):
        words = [rnd.choice("one two three four five six seven eight nine ten".split()) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(5, 300))]
        for copies in range(rnd.randint(1, 7)):
            texts.append(" ".join(words))
            words = [w if rnd.random() > rnd.choice([0, 0.01, 0.02, 0.04]) else "changed" + str(rnd.random()) for w in words]
    root = groups_by_hand(texts)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(3)
    kept = [k for k in range(len(texts)) if root[k] == k]
    assert 25 <= len(kept) < len(set(texts))
    assert as_rows(simhash.keep_one_copy(frame), "doc_id") == sorted(((k,) for k in kept), key=repr)
    assert simhash.keep_one_copy(frame.limit(0)).count() == 0


def test_near_copies_of_the_small_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())
    firsts = {}
    for i, t in rows:
        firsts.setdefault(t, i)
    sets = {i: {h for h in simhash.shingle_set((t or "").encode()).tolist()} for t, i in firsts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert links  # near copies are planted
    root = closed(links, sorted(sets))
    assert as_rows(simhash.keep_one_copy(frame), "doc_id") == sorted(((i,) for i in sets if root[i] == i), key=repr)


@pytest.mark.parametrize(("changed", "block"), [(4, 256), (9, 20), (16, 5)])
def test_a_large_group_of_copies_with_changes(spark, monkeypatch, changed, block):
    """Texts on one template, some alike enough to link, others not; also where a key's texts are in many blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(changed)
    template, texts = [f"w{k}" for k in range(150)], []
    for _ in range(120):
        words = list(template)
        for k in rnd.sample(range(150), rnd.randint(0, changed)):
            words[k] = f"v{rnd.random()}"
        texts.append(" ".join(words))
    root = groups_by_hand(texts)
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, _row int, fp int").coalesce(3)
    kept = simhash.keep_one_copy(frame)
    assert kept.columns == frame.columns
    found = [r["doc_id"] for r in kept.collect()]
    want = [k for k in range(len(texts)) if root[k] == k]
    assert sorted(found) == want and len(want) < 120


def test_near_copies_meet_in_balls_of_fingerprints(spark):
    """Without MinHash bands: near copies at most 5 bits apart are linked by their fingerprints' halves, and no other texts are."""
    rnd = random.Random(21)
    texts = ["", " ", "a b", "a c"]
    for _ in range(30):
        words = [f"w{rnd.randint(0, 999)}" for _ in range(rnd.randint(100, 300))]
        texts += [" ".join(words), " ".join([*words[:-2], "x", "y"]), " ".join([*words[:40], f"v{rnd.random()}", *words[40:]])]
    prints = [(k, *simhash._copy_prints(t.encode())[:2], []) for k, t in enumerate(texts)]
    prints += [(len(texts) + k, 17 + k, [5 ^ k, 1 << 32], []) for k in range(3)]  # alike by fingerprint, not by their words
    texts += [f"one{k} two three{k} four five{k} six seven{k}" for k in range(3)]
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(prints[a][2], prints[b][2], strict=True))
    worded = [k for k, p in enumerate(prints) if p[2]]
    close = [(a, b) for a in worded for b in worded if a < b and apart(a, b) <= 5]
    alike = [(a, b) for a, b in close if jaccard_by_hand(texts[a], texts[b]) >= 0.8]
    assert len(alike) > 30 and len(close) >= len(alike) + 3
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    made = spark.createDataFrame(prints, "row long, fp long, halves array<long>, keys array<long>")
    found = {(r["a"], r["b"]) for r in simhash.copy_links(rows, made, "row").collect()}
    of = {p[1]: k for k, p in enumerate(prints)}
    assert all(jaccard_by_hand(texts[of[a]], texts[of[b]]) >= 0.8 for a, b in found)
    group = closed([(of[a], of[b]) for a, b in found], range(len(texts)))
    assert all(group[a] == group[b] for a, b in alike)


def test_one_row_of_repeated_rows_and_null_ids_stays(spark):
    rows = [(7, "a text of its own"), (7, "a text of its own"), (7, "another one"), (None, "with id once"), (None, "without any id"), (None, "without any id"), (3, "with id once")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = [(7, "a text of its own"), (7, "another one"), (3, "with id once"), (None, "without any id")]
    assert as_rows(simhash.keep_one_copy(frame), "doc_id", "text") == sorted(want, key=repr)


def test_ball_links_reach_radius_two_and_no_further(spark):
    rnd = random.Random(3)
    prints = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(prints):
        for k in range(5):
            for _ in range(k % 4):
                f ^= 1 << rnd.randrange(64)
            prints.add(f)
    prints |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 63) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.components(simhash.ball_links(frame))
    got = {r["node"]: r["root"] for r in found.collect()}
    links = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    want = closed(links, signed)
    assert {n: got.get(n, n) for n in signed} == want


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got[200] == 0
    assert {v for k, v in got.items() if 1000 < k < 1300} == {1000}
    assert 5000 not in got


# ------------------------------------------------------------------ chat


def test_chat_round_trip(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "a\\b\\\\", "<s>\n</s>\n", "<</s>", "[[INST]", "\\</s>", "é\0\n" * 3, "<", "</", "</s", "<|im_end|>"]
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", None, "sy\nstem", "<s>"]), rnd.choice(odd) , 1) for c in [*range(30), None] for t in range(rnd.randint(1, 9))]
    rows += [(3, 0, "user", "tie", 1), (3, 0, "user", "tie", 1), (4, None, "assistant", "no turn", 1), (99, 0, "assistant", "x" * 300_000, 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(3)
    for part_bytes in (1 << 24, 50):
        made = chat.format_conversations(frame, part_bytes)
        got = as_rows(chat.digests(made), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
        want = []
        for conv in {r[0] for r in rows}:
            turns = sorted((r[1:4] for r in rows if r[0] == conv), key=lambda r: tuple((v is not None, v) for v in r))
            said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)
            loss = "".join(text or "" for _, role, text in turns if role == "assistant")
            want.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    texts = [r["formatted"] for r in chat.format_conversations(frame).collect()]
    assert all(t.count("</s>") == len(chat.read_turns(t)) and "[INST]" not in t for t in texts)


@pytest.mark.parametrize("batch", [1, 2, 3])
def test_chat_conversations_that_end_with_a_batch(spark, batch):
    rows = [(c, t, "assistant", f"turn {t} of {c} " + "x" * 40) for c in [*range(12), None] for t in range(1 + (c or 3) % 4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        made = chat.format_conversations(frame, 20)
        parts = as_rows(made, "conv_id", "part")
        got = as_rows(chat.digests(made), "conv_id", "n_turns")
    finally:
        spark.conf.set(name, old)
    assert got == sorted(Counter(r[0] for r in rows).items(), key=repr)
    assert {c: sorted(p for d, p in parts if d == c) for c, _ in parts} == {c: list(range(sum(d == c for d, _ in parts))) for c, _ in parts}


# ------------------------------------------------------------------ suffix arrays


def test_suffix_array_equals_sorting():
    rnd = random.Random(2)
    for _ in range(600):
        text = [rnd.randint(1, rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 40))] + [0]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def removed_by_hand(rows):
    coded = [((1 << 63) - 1 if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for order, _, data in sorted(coded, key=lambda r: r[0]):
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], order)
    out = []
    for order, i, data in coded:
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < order:
                gone[k : k + 50] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((i, len(data), int(gone.sum()), int((gone[:-1] & ~np.roll(gone, 1)[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_bytes", [1 << 22, 20_000, 3_000])
def test_removals_equal_brute_force(documents, group_bytes):
    docs, rows = documents
    got = as_rows(suffixes.removals(docs, group_bytes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed_by_hand(rows)


def test_removals_over_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = as_rows(suffixes.removals(docs, 30_000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed_by_hand(rows)
    cleaned = {r["doc_id"]: r for r in suffixes.without_repeats(docs).collect()}
    assert len(cleaned) == len(rows)
    assert all(cleaned[i]["text"] == t for (i, t), r in zip(sorted(rows), sorted(got), strict=True) if r[2] == 0)


# ------------------------------------------------------------------ decontamination


def hits_by_hand(text, items):
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    words, hit, found = split(text), set(), set()
    for item, said in items:
        held = split(said)
        size = min(10, len(held))
        for k in range(len(held) - size + 1 if held else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == held[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(-1 if item is None else item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [1 << 19, 100])
def test_report_equals_brute_force(spark, block_words):
    rnd = random.Random(8)
    make = lambda n: " ".join(rnd.choice("one two three four five Six sévén 8".split()) for _ in range(n))
    items = [(k, make(rnd.choice([3, 6, 9, 10, 11, 30]))) for k in range(12)] + [(50, None), (51, " .. "), (None, make(12)), (2, "six Six six five")]
    docs = [(k, f"{make(rnd.randint(0, 30))}. {rnd.choice(items)[1] or ''} {make(5)}") for k in range(40)] + [(90, None), (91, ""), (92, "?!")]
    docs.append((93, make(3000)))
    items[11] = (11, docs[-1][1][2000:9000])
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n_hit int, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.hits(frame.select("doc_id", "text"), bench, 10, block_words)
    spans = {r["doc_id"]: sum(r["_hits"]["ends"]) - sum(r["_hits"]["starts"]) for r in found.collect()}
    assert spans == {i: hits_by_hand(t, items)[1] for i, t in docs}
    got = as_rows(decontam.report(frame, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((i, *hits_by_hand(t, items)) for i, t in docs), key=repr)


def test_cleaning_removes_passages_and_leaves_clean_texts(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    clean = "nothing of the benchmark is in this text, " * 3
    docs = spark.createDataFrame(
        [(1, f"{clean}{item.upper()}! {clean}", 1), (2, item, 2), (3, clean, 3), (4, None, 4), (5, "", 5)], "doc_id long, text string, n_chars long"
    )
    got = {r["doc_id"]: r for r in decontam.cleaned(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert sorted(got) == [1, 3, 4, 5]
    assert got[1]["text"] == f"{clean}! {clean}" and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[3]["text"], got[3]["n_chars"], got[4]["text"], got[5]["text"]) == (clean, 3, None, "")


# ------------------------------------------------------------------ toxicity


@pytest.fixture(scope="module")
def classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels, toxicity.train(docs, labels)


def test_toxicity_on_held_out_rows(classifier):
    docs, labels, learned = classifier
    rows = toxicity.scores(docs, learned).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score", "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    told = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert told[0, 0] / (told[0, 0] + told[0, 1]) > 0.98
    assert told[1, 1] / (told[1, 1] + told[1, 0]) > 0.7


@pytest.mark.parametrize(("written", "meant"), [("1d1ot", "idiot"), ("stuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("tr@sh", "trash"), ("IDIOT!!", "idiot"), ("l0s3r", "loser"), ("that***", "that")])
def test_obfuscated_words_are_restored(classifier, written, meant):
    assert toxicity.restore(written.lower(), classifier[2].model) == meant


def test_toxicity_edges(spark, classifier):
    learned = classifier[2]
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "you are an i d i o t and tr@sh", 1), (3, "fine words", 1), (None, "x" * 100_000, 1)], "doc_id long, text string, score int")
    got = as_rows(toxicity.scores(docs, learned), "doc_id", "predicted")
    assert got == sorted([(1, 0), (2, 0), (3, 1), (3, 0), (None, 0)], key=repr)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.scores(docs, toxicity.train(docs, none)).collect()} == {0}
    assert toxicity.scores(docs.limit(0), learned).count() == 0


# ------------------------------------------------------------------ URLs


def judged_by_hand(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and host and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("shuffle", [1, 4, 13])
def test_urls_equal_brute_force(spark, shuffle):
    rnd = random.Random(4)
    labels = ["a", "b", "net", "org", "a-b", "x", "é", ""]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "a", "b/"]) for _ in range(rnd.randint(0, 3)))
    rules = [(rnd.choice(["allow", "block"]), host() or "net", "/" + path()) for _ in range(40)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules if h.strip(".")}.values())
    found = [f"http://{host()}{path()}{rnd.choice(['', '?q=://', '#t/'])}" for _ in range(300)] + ["HTTP://A.Net/a://b", "no scheme/", "", None, "://", "x://\nb/a"] * 2
    found += ["http://net/a"] * 200
    pages = spark.createDataFrame([(k, u, "k") for k, u in enumerate(found)], "page_id long, url string, key string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffle))
    try:
        got = as_rows(urls.judge(pages, urls.rule_table(pages, rules)), "page_id", "host", "path", "rule", "verdict")
        none = urls.judge(pages.limit(5), urls.rule_table(pages, rules).limit(0))
        assert {r["verdict"] for r in none.collect()} == {"allow"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(((k, *judged_by_hand(u, rules)) for k, u in enumerate(found)), key=repr)


# ------------------------------------------------------------------ HTML


def test_main_text_of_marked_and_unmarked_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.train(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in html.extract(pages, model).collect())
    article = re.compile("<article>(.*?)</article>", re.DOTALL)
    for r in pages.limit(60).collect():  # the article is all of the main text of these pages
        inner = html.parse(article.search(r["html"])[1])
        want = [" ".join("".join(t).split()) for _, t in inner.texts]
        assert html.main_text(r["html"], model) == "\n".join(b for b in want if b)
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
      <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>bold</b> <a href=y>link</a> text.<p>Second
      &lt;one&gt; &#233;<script>var x="<p>no</p>"</script><form><input><label>Mail</label></form><aside>Related</aside><ul><li>item one<li>item two</ul>
      <div class="comments"><p>I like it</p></div></article><aside class="sidebar"><p>Other posts</p></aside><footer>&copy; me</footer></body></html>"""
    assert html.main_text(page, model) == "Head & line\nFirst bold link text.\nSecond <one> é\nitem one\nitem two"
    plain = """<body><div id=menu><p>Start</p></div><div><h1>Title</h1><p>A text that no element marks as the article of this page.</p><p>It goes on.</p>
      </div><div class=footer><p>Imprint</p></div>"""
    assert html.main_text(plain, model) == "Title\nA text that no element marks as the article of this page.\nIt goes on."


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 1), (3, "u", "<p>", 1), (None, "u", "<article><p>" + "é " * 50_000, 1), (3, "u", "</p></x><<<&", 1)], "page_id long, url string, html string, text int")
    got = as_rows(html.extract(pages), "page_id", "n_chars")
    assert len(got) == 5 and (None, 99_999) in got and (1, 0) in got and (2, 0) in got
    assert html.extract(pages.limit(0)).count() == 0


def test_a_head_without_end_tag_hides_no_text():
    model = html.Model.of({})
    for body in ("<body><article><p>text", "<article><p>text", "<meta name=x><link><article><p>text", "</head><body><article><p>text", "<img><main><p>text"):
        assert html.main_text(f"<html><head><title>T</title><script>var x</script>{body}", model) == "text"
    assert [t for _, t in html.parse("<head><title>T</title> bare words").texts] == [[" bare words"]]


def test_messages_give_exact_marginals():
    rnd = random.Random(6)
    for _ in range(30):
        page = html.Page()
        for k in range(7):
            page.tags.append(rnd.choice(["a", "b", "body"]))
            page.names.append([])
            page.parents.append(rnd.randrange(k) if k else -1)
            page.chars.append(0)
            page.linked.append(0)
        model = html.Model({f"tag {t}": rnd.uniform(-2, 2) for t in ("a", "b", "body")}, rnd.uniform(-1, 1), ((-0.2, -1.7), (-1.1, -0.4)), ((-0.7, -0.7), (-0.1, -2.4)))
        weight = defaultdict(float)
        for code in range(128):
            y = [code >> k & 1 for k in range(7)]
            score = y[0] * model.root + sum(y[k] * model.odds[f"tag {page.tags[k]}"] + model.potentials(page, k)[y[page.parents[k]]][y[k]] for k in range(1, 7))
            for k in range(7):
                weight[k, y[k]] += np.exp(score)
        want = [weight[k, 1] / (weight[k, 0] + weight[k, 1]) for k in range(7)]
        assert np.allclose(model.marginals(page), want)


# ------------------------------------------------------------------ BPE


@pytest.fixture(scope="module")
def config():
    return bpe.read_config(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark, config):
    rnd = random.Random(1)
    alphabet = "aeiouthsr'  \n.,<>|é0Σß你́\0"
    found = ["", "<|endoftext|>", "x <|startoftext|>y's don't I'LL", "ΑΣ ΣΑΣ İstanbul ǅ", "１２３ ½ ²", "é\x85z\x1cq", "aaaaaaaaaaaaa bbbb", "<|endoftext|><|END|>", "😀 👨‍👩‍👧", None]
    found += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(500)] + ["lorem " * 20_000]
    found += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(found)], "doc_id long, text string, ids int")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in found]
    assert as_rows(bpe.encode(docs, config), "doc_id", "ids") == sorted(enumerate(want), key=repr)
    digest = lambda data: hashlib.sha256(data).hexdigest()
    rows = [(k, len(i), digest(np.array(i, "<u4").tobytes()), digest(library.decode(i, skip_special_tokens=False).encode())) for k, i in enumerate(want)]
    assert as_rows(bpe.digests(docs, config), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(rows, key=repr)
    assert bpe.digests(docs.limit(0), config).count() == 0


def test_bpe_forgets_words_beyond_its_memory(config, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    memory = bpe.Memory(bpe.Tokenizer(config))
    once = [memory.encode([t])[0].tolist() for t in ("a b c d", "e f g h", "a b c d")]
    assert once[0] == once[2]


# ------------------------------------------------------------------ quality


def measures_by_hand(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    times = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) for j in range(5) if times[tuple(words[k : k + 5])] > 1}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(line in lines[:k] for k, line in enumerate(lines)), len(covered)


def test_quality_equals_brute_force(spark, documents):
    rows = documents[1] + [(2000, "a b c d e f g\n" * 4), (2001, "one two three four five six seven eight nine ten"), (2002, "\u00a0 \u2003x\x85y\x1cz")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    found = quality.judge(docs)
    want = []
    for i, t in rows:
        m = measures_by_hand(t)
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        other = 16 * m[2] > m[1] or 3 * m[3] > (t or "").count("\n") + 1 or not 2 * m[0] <= m[1] <= 25 * m[0]
        want.append((i, *m, failed, not failed and not other))
    assert as_rows(found, "doc_id", *quality.MEASURES, "base_failed", "kept") == sorted(want, key=repr)
    assert quality.judge(docs.limit(0)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([(k, "word " * 50) for k in range(200)], "doc_id long, text string")

    def slow(text):
        return sum(range(20_000)) > 0

    rules = (quality.Rule("never", lambda t: False), quality.Rule("slow", slow), quality.Rule("quick", lambda t: True))
    assert [r.name for r in quality.measured_order(docs, rules)] == ["quick", "slow", "never"]
    seen = []
    quality.first_rejection(quality.Text("x"), [quality.Rule("a", lambda t: True), quality.Rule("b", lambda t: seen.append(1))])
    assert not seen


# ------------------------------------------------------------------ empty tables


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for frame in (
        shards.extendible_shards(docs),
        simhash.near_duplicates(docs),
        suffixes.removals(docs),
        suffixes.without_repeats(docs),
        decontam.report(docs, bench),
        decontam.cleaned(docs, bench),
        toxicity.without_toxic(docs, labels),
        chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.rule_table(docs, urls.RULES)),
    ):
        assert frame.count() == 0
    full = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert decontam.report(full, bench).first()["contaminated"] is False
    assert full.select(F.col("doc_id")).count() == 1
