"""Personal data, periodic runs and fill-in-middle against brute force; nulls, empty and long texts, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlab.llm import infill, periods, privacy, suffixes
from trendlab.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
CLASHES = ["row", "key", "base", "maybe", "added", "word", "value", "n", "form", "output", "runs", "start", "cell", "place"]


def frame(spark, rows):
    extra = [(i, t, *[7] * len(CLASHES)) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHES)).repartition(4)


def as_rows(found, *columns):
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)


# ------------------------------------------------------------------ personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def slow_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and slow_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def test_patterns_equal_the_plain_expressions():
    rnd = random.Random(3)
    parts = ["a@b.co", "x.y@", "@b.c", "a@b@c.d.e", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "007.0.0.1", "9.", "4316522678525456", "4316 5226-7852 5456"]
    parts += ["+1 (743) 555-3824", "+1--", "+12", "++49 30 1234567 ", " ", "-", "é@x.y", "a+b@c-d.e-f", "12 34", ".", "\n", "0000 0000 0000", "@"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert privacy.base_spans(text) == slow_spans(text), text
    for r in __import__("pyarrow.parquet", fromlist=["x"]).read_table(f"{SMALL}/documents.parquet", columns=["text"]).to_pylist():
        assert privacy.base_spans(r["text"]) == slow_spans(r["text"])


def test_long_texts_of_pattern_characters_take_linear_time():
    for text in ("a" * 10**6, "1" * 10**6, "1 " * 500_000, "+1" * 500_000, "a." * 500_000, "@" * 10**6, "1." * 500_000 + "x", "a@b" * 300_000):
        assert isinstance(privacy.base_spans(text), list)


def slow_disclosure(rows, window=privacy.WINDOW):
    """{word: largest disclosure of a value it was met with in several contexts}, counted place by place."""
    total, near, contexts, of_value = Counter(), Counter(), defaultdict(set), Counter()
    for _, text in rows:
        text = text or ""
        spans = slow_spans(text)
        free = [m for m in re.finditer(r"[^\W_]+", text) if not any(m.start() < b and a < m.end() for a, _, b in spans)]
        total.update(m[0].lower() for m in free)
        places = defaultdict(set)
        for a, kind, b in spans:
            name = privacy.value(text[a:b], kind)
            left = [k for k, m in enumerate(free) if m.start() < a][-window:]
            right = [k for k, m in enumerate(free) if m.start() >= a][:window]
            context = tuple(free[k][0].lower() for k in left + right)
            for k in left + right:
                places[name].add(k)
                contexts[name, free[k][0].lower()].add(context)
        for name, held in places.items():
            of_value[name] += len(held)
            near.update((name, free[k][0].lower()) for k in held)
    size, out = sum(total.values()), {}
    for (name, word), n in near.items():
        if len(contexts[name, word]) > 1 and of_value[name] < size:
            share = math.log(size * n / (of_value[name] * total[word])) / math.log(size / of_value[name])
            out[word] = max(out.get(word, -1), share)
    return out


@pytest.fixture(scope="module")
def private(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    some = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    rows = [(k, some(rnd.randint(0, 60))) for k in range(40)]
    for k in range(12):  # a person who is named beside one address, and a code number beside one phone
        rows.append((100 + k, f"{some(12)} Zorblaxia Quint zq{rnd.randint(0, 9)} j.doe@mail1.example.com {some(15)}"))
        rows.append((200 + k, f"{some(3)} +1 (743) 555-3824 badge AX7731 {some(9)} 4316522678525456"))
    rows += [(300, "we met zorblaxia again"), (301, "Zorblatt is someone else"), (302, "zorblatt zorbla"), (303, rows[-1][1])]
    rows += [(400, None), (None, "no id but 10.0.0.1 here"), (None, "no id but 10.0.0.1 here"), (401, ""), (402, "x" * 10_000), (403, "+1 " * 30)]
    return frame(spark, rows), rows


def test_personal_data_equals_counting_by_hand(private):
    docs, rows = private
    share = slow_disclosure(rows)
    flagged = {w for w, d in share.items() if d >= privacy.DISCLOSURE}
    assert {"zorblaxia", "ax7731"} <= flagged and "zorblatt" not in flagged
    want = []
    for i, text in rows:
        text = text or ""
        spans = slow_spans(text)
        base = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans)
        free = [m for m in re.finditer(r"[^\W_]+", text) if not any(m.start() < b and a < m.end() for a, _, b in spans)]
        added = [(m.start(), 4, m.end()) for m in free if m[0].lower() in flagged]
        every = ",".join(f"{[*PATTERNS, 'term'][k]}:{a}:{b}" for a, k, b in sorted(spans + added))
        want.append((i, *[sum(s[1] == k for s in spans) for k in range(4)], len(added), base, every))
    got = as_rows(privacy.personal_data(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_term", "base", "spans")
    assert got == sorted(want, key=repr)


def test_disclosing_words_are_generalised_or_removed(private):
    docs, rows = private
    counts = privacy.cooccurrence(docs)
    found = {r["word"]: r for r in privacy.disclosing_words(counts).collect()}
    share = slow_disclosure(rows)
    assert found.keys() == {w for w, d in share.items() if d >= privacy.DISCLOSURE}
    assert all(math.isclose(r["disclosure"], share[w], rel_tol=1e-9) for w, r in found.items())
    assert found["zorblaxia"]["replacement"] == "zorbla*"  # shared with words that stand elsewhere
    assert found["ax7731"]["replacement"] == ""
    clean = {r["doc_id"]: r for r in privacy.sanitised(docs).collect()}
    assert privacy.sanitised(docs).columns == docs.columns
    assert clean[300]["text"] == "we met zorbla* again" and clean[301]["text"] == "Zorblatt is someone else"
    assert clean[400]["text"] is None and clean[401]["text"] == "" and clean[402]["text"] == "x" * 10_000
    assert clean[None]["text"] == "no id but <IP> here" and clean[None]["key"] == 7
    for i, text in rows:
        assert i is None or not text or not slow_spans(clean[i]["text"]), text


def test_the_filter_holds_every_word_and_few_others(spark):
    words = [f"w{k}é" for k in range(3000)]
    chosen = privacy.WordFilter.of(spark.createDataFrame([(w,) for w in words], "word string"))
    assert chosen.maybe(words) == set(words)
    assert len(chosen.maybe([f"v{k}" for k in range(20000)])) < 20
    assert privacy.WordFilter.of(spark.createDataFrame([], "word string")).maybe(words) == set()


def test_personal_data_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert privacy.personal_data(docs).collect() == [] and privacy.sanitised(docs).collect() == []


# ------------------------------------------------------------------ periodic runs


def slow_runs(words, least=periods.MIN_WORDS):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(seed, most=160):
    rnd = random.Random(seed)
    kinds, n = rnd.choice([1, 2, 3, 9, 60]), rnd.randint(0, most)
    words = [f"w{rnd.randrange(kinds)}" for _ in range(n)]
    for _ in range(rnd.randint(0, 3) if n > 3 else 0):
        a = rnd.randrange(n)
        p, b = 1 + (n - a) // rnd.randint(2, 9), rnd.randint(a, n)
        for i in range(a, b):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_equal_a_scan_of_every_lag(monkeypatch):
    texts = [periodic_words(seed) for seed in range(150)]
    want = [slow_runs(words) for words in texts]
    assert sum(map(len, want)) > 100
    assert periods.runs_of([[w.encode() for w in words] for words in texts]) == want
    monkeypatch.setattr(periods, "_WINDOW", 4)  # lags over 8 take the sampled path
    for words, runs in zip(texts, want, strict=True):
        numbers = np.unique(words, return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)
        assert sorted((a, b - a, q) for a, b, q in periods.runs(numbers, dense=8)) == sorted(runs)


def slow_split(words, a, b):
    """Segments by the definition: split at words that occur once, recurse."""
    once = [k for k in range(a, b) if words[a:b].count(words[k]) == 1]
    if not once:
        return [(a, b)] if b - a >= periods.MIN_WORDS else []
    cuts = [a - 1, *once, b]
    return [s for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for s in slow_split(words, lo + 1, hi)]


@pytest.mark.parametrize("slow", [0, 32, 10**9])
def test_splitting_recurses_to_stability(monkeypatch, slow):
    monkeypatch.setattr(periods, "_SLOW", slow)  # bulk rounds only, as built, or one segment after the other
    for seed in range(60):
        words = periodic_words(seed, 120)
        numbers = np.array([int(w[1:]) for w in words], np.int64)
        assert periods.split(numbers) == slow_split(words, 0, len(words))


def test_long_runs_take_bounded_time():
    for numbers in (np.zeros(30_000), np.tile(np.arange(15_000), 2), np.tile(np.arange(700), 100)):
        assert len(periods.runs(numbers.astype(np.int64))) == 1


def slow_planted(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def want_of(doc_id, words):
    found = slow_runs(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([" ", "\n ", "\t"]).join(periodic_words(k, 90))) for k in range(80)]
    rows += [(500, None), (501, ""), (502, " \n "), (None, "a b " * 20), (None, None), (3, rows[3][1]), (503, "é" * 50_000), (504, "ab c " * 40)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = as_rows(QUERIES["op12_periodic_runs"](spark, str(tmp_path)), *RUN_COLUMNS)
    assert got == sorted((want_of(i, slow_planted(i, t)) for i, t in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 4


def test_periodic_runs_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periods.periodic_runs(docs).collect() == []


# ------------------------------------------------------------------ fill-in-middle


def slow_infill(doc_id, text):
    text, units = text or "", []
    for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text or ""):
        units.append(m[0])
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    x, y = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_fill_in_middle_equals_brute_force_and_comes_back(spark):
    rnd = random.Random(4)
    alphabet = ["a", "Zz", "é", "<", ">", "<S", "P>", "M", " ", "\n", "😀", "\0", "1"]
    rows = [(k, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))) for k in range(300)]
    rows += [(900, None), (901, ""), (None, "no id"), (None, None), (902, "has <P> in it"), (5, rows[5][1]), (903, "word " * 60_000), (904, "a" * 300_000)]
    made = infill.fill_in_middle(frame(spark, rows))
    assert as_rows(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted((slow_infill(i, t) for i, t in rows), key=repr)
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}
    back = made.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("text"))
    assert as_rows(back, "doc_id", "text") == sorted(((i, t or "") for i, t in rows), key=repr)


def test_long_texts_are_matched_in_pieces():
    rnd = random.Random(6)
    for _ in range(300):
        text = "".join(rnd.choice(["ab", "c", " ", "é", "."]) for _ in range(rnd.randint(0, 60)))
        h1, h2 = rnd.randrange(1 << 32), rnd.randrange(1 << 32)
        whole = infill.cut(text, h1, h2)
        for limit in (1, 2, 7, 20):
            assert infill.cut(text, h1, h2, limit) == whole


def test_fill_in_middle_of_an_empty_table(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ------------------------------------------------------------------ earlier operators with names of their helpers


def test_repeats_go_whatever_the_other_columns_are_called(spark):
    passage = "a passage of well over fifty bytes that stands in two of the documents"
    rows = [(1, passage), (2, f"before {passage} after"), (None, f"{passage}!"), (3, None), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in rows], "doc_id long, text string, _group int, _id int, bucket int").repartition(2)
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns
    want = [(1, passage), (2, "before  after"), (None, "!"), (3, None), (3, None), (4, "")]
    assert as_rows(left, "doc_id", "text", "_group", "_id", "bucket") == sorted(((i, t, 5, 6, 7) for i, t in want), key=repr)
    assert suffixes.without_repeats(docs.limit(0)).collect() == []
