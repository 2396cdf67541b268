"""The operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, start string, taken string"


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    long = " ".join(found[0][1].split() * 40)
    base = [f"w{k}" for k in range(120)]
    near = [(2000 + k, " ".join([*base[: 7 * k], f"other{k}", *base[7 * k + 1 :]]), "near") for k in range(6)]
    odd = [(None, found[1][1], "a"), (1000, None, None), (1001, "", "a"), (1002, " \n\t ", "b"), (1003, long, "b"), (1004, "a b", "a"), (1005, "a b", None), (3, found[3][1], found[3][2]), (1006, "a " * 60, "a"), (1007, "a " * 30, "a")]
    secret = [(1100, 'password = "abcdefgh12" AKIAABCDEFGHIJKL12 token: secret : longvalue1234', "a"), (1101, "x" + "deadbeef" * 5 + " ghp_" + "A1" * 20, "b")]
    return found + near + odd + secret


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


def words(text):
    return (text or "").encode().split()


def ordered(found):
    return sorted(found, key=lambda r: [(x is None, str(x)) for x in r])


def test_token_counts(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from skein.llm.token_counts import token_counts

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 1024) for i, x, _ in rows]
    assert ordered(map(tuple, token_counts(docs).collect())) == ordered(want)
    assert token_counts(empty).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", " x\n y ", "it's <|endoftext|> a<|endoftext|>", "\x1c a \x85 b", "日本 語　で", "a\n\n b\tc  "])
def test_token_counts_at_odd_spaces(text):
    import public_tokenizers

    from skein.llm.token_counts import Counter as TokenCounter

    c = TokenCounter(public_tokenizers.path("byte_bpe_50k.json"), 8)
    assert c.count([text]) == [len(c.tokenizer.encode(text, add_special_tokens=False))]


def test_substring_dedup(docs, rows, empty):
    from skein.llm import substring_dedup as S

    first = {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, t, _ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone |= {*range(k, k + 13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    for hot, options in ((1000, {}), (1, {}), (1, {"broadcast_rows": 0})):
        S.HOT, was = hot, S.HOT
        try:
            assert ordered(map(tuple, S.dedup_substrings(docs, shard_words=5000, **options).collect())) == ordered(want)
        finally:
            S.HOT = was
    assert S.dedup_substrings(empty).count() == 0


def test_hot_passages_go_back_by_window(spark):
    """A passage in a third of all rows, whole copies and clean rows; the passage's first holder keeps it."""
    from skein.llm import substring_dedup as S

    line = " ".join(f"l{k}" for k in range(20))
    made = [(k, f"a{k} b{k} " + (line if k % 3 == 0 else "") + f" c{k} d{k}" + (f" again{k % 5}" * 14 if k % 7 == 0 else "")) for k in range(1, 200)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    S.HOT, was = 10, S.HOT
    try:
        got = {r.doc_id: r.n_removed for r in S.dedup_substrings(d).collect()}
    finally:
        S.HOT = was
    first, want = {}, {}
    for i, t in made:
        w, gone = t.split(), set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone |= {*range(k, k + 13)}
        want[i] = len(gone)
    assert got == want and sum(x > 0 for x in want.values()) > 60


def test_word_hashes_tell_words_apart(rows):
    """Every text's words, over pieces of any size, with words longer than a piece."""
    from skein.llm import text as T

    odd = [b"", b" ", b"a" * 300 + b" b", b"\n x\ty ", b"\x0b\x0c\r", "é ü é".encode(), b"Ab aB ab"]
    made = [*odd, *((t or "").encode() for _, t, _ in rows)]
    for piece in (16, 1 << 17):
        T.PIECE, was = piece, T.PIECE
        try:
            for lower in (False, True):
                hashes, starts = T.hash_words(made, lower)
                flat = [w.lower() if lower else w for t in made for w in t.split()]
                assert starts.tolist() == [0, *itertools.accumulate(len(t.split()) for t in made)]
                assert len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(hashes.tolist(), flat)))
        finally:
            T.PIECE = was
    assert T.hash_words([])[0].size == 0


def test_fm_index_gives_matching_statistics():
    import numpy as np

    from skein.llm.fm_index import FMIndex

    rng = np.random.default_rng(1)
    sizes = rng.integers(10, 25, 200)
    flat = rng.integers(1, 6, sizes.sum())
    owners = rng.integers(0, 50, 200)
    starts = np.cumsum(sizes) - sizes
    seen = defaultdict(list)
    for s, n, owner in zip(starts, sizes, owners):
        for a in range(n):
            for b in range(a + 1, min(a + 13, n) + 1):
                seen[tuple(flat[s + a : s + b].tolist())].append(owner)
    index = FMIndex(flat, sizes, owners, 13)
    stream = rng.integers(0, 6, 400)
    stream[100:120], stream[200:222] = flat[:20], flat[40:62]
    ends = np.arange(1, 401)
    size, lo, hi = index.statistics(stream, ends, 13)
    for e, n, a, b in zip(ends, size, lo, hi):
        best = max((k for k in range(1, min(13, e) + 1) if tuple(stream[e - k : e].tolist()) in seen), default=0)
        assert n == best and b - a == (len(seen[tuple(stream[e - n : e].tolist())]) if n else 0)
    same = size == 4
    assert index.least_owner(lo[same], hi[same]).tolist() == [min(seen[tuple(stream[e - 4 : e].tolist())]) for e in ends[same]]


def shingle_sets(rows):
    out = []
    for _, t, _ in rows:
        w = words(t)
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


@pytest.mark.parametrize("options", [{}, {"large": 3, "steps": 2, "block": 4}])
def test_jaccard_classes(docs, rows, options):
    from skein.llm.jaccard_join import jaccard_classes

    sets = shingle_sets(rows)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    name = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        name[find(k)].append(i)
    want = [(i, min((x for x in name[find(k)] if x is not None), default=None), links[k]) for k, (i, _, _) in enumerate(rows)]
    got = jaccard_classes(docs, **options).select("doc_id", "class_id", "n_links").collect()
    assert ordered(map(tuple, got)) == ordered(want)


@pytest.mark.parametrize("options", [{}, {"large": 50}, {"large": 50, "steps": 2}])
def test_jaccard_recall_in_hot_buckets(spark, options):
    """Pairs just above the threshold whose sets share a passage with all others, and a large group of near copies."""
    from skein.llm.jaccard_join import RECALL, jaccard_classes

    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(600):
        own = [f"w{k}x{j}" for j in range(60)]
        rows.append((2 * k, " ".join(passage + own)))
        rows.append((2 * k + 1, " ".join(passage + own[:30] + [f"new{k}"] + own[31:] + [f"more{k}y{j}" for j in range(14)])))
    crowd = [f"c{j}" for j in range(200)]
    rows += [(10_000 + k, " ".join(crowd[:j] + [f"z{k}"] + crowd[j + 1 :])) for k in range(300) for j in [(7 * k) % 190]]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows[:2])]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    met = sum(got[2 * k + 1] == (2 * k, 1) for k in range(600))
    assert met >= RECALL * 600 - 3 * (RECALL * (1 - RECALL) * 600) ** 0.5 or (options.get("steps") == 2 and met >= 0.95 * 600)
    assert all(got[10_000 + k] == (10_000, 299) for k in range(300))


@pytest.mark.parametrize("common", [60, 330])
def test_jaccard_loses_no_link_in_buckets_that_stay_large(spark, common):
    """All sets share so much that no step tells them apart; 60: their prefixes do, 330: even these are in blocks."""
    from skein.llm.jaccard_join import RECALL, jaccard_classes

    passage = [f"p{k}" for k in range(common)]
    rows = []
    for k in range(300):
        own = [f"w{k}x{j}" for j in range(60)]
        rows.append((2 * k, " ".join(passage + own)))
        rows.append((2 * k + 1, " ".join(passage + own[:30] + [f"new{k}"] + own[31:] + [f"more{k}y{j}" for j in range(14 + (common - 60) // 5)])))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85 and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.8
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), large=20, steps=1).collect()}
    met = sum(got[2 * k + 1] == (2 * k, 1) for k in range(300))
    assert met >= RECALL * 300 - 3 * (RECALL * (1 - RECALL) * 300) ** 0.5


def test_keep_first_drops_copies_in_buckets_that_stay_large(spark):
    from skein.llm.jaccard_join import RECALL, keep_first

    rows = []
    for k in range(300):
        text = [f"p{j}" for j in range(60)] + [f"w{k}x{j}" for j in range(60)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[:90] + [f"new{k}"] + text[91:] + [f"more{k}y{j}" for j in range(14)]))]
    kept = {r.doc_id for r in keep_first(spark.createDataFrame(rows, "doc_id long, text string"), large=20, steps=1).collect()}
    assert all(2 * k in kept for k in range(300))
    assert len(kept) - 300 <= 300 - RECALL * 300 + 3 * (RECALL * (1 - RECALL) * 300) ** 0.5


def test_jaccard_keeps_one_of_each_class(docs, rows, empty):
    from skein.llm.jaccard_join import jaccard_classes, keep_first

    classes = jaccard_classes(docs).collect()
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    texts = [r for r in kept.collect() if words(r.text)]
    assert len(texts) == len({r.class_id for r in classes if r.doc_id not in (1000, 1001, 1002)})
    assert keep_first(empty).count() == 0


def test_masks_lose_nothing():
    from skein.llm.decontaminate import MASKS, SHORT_MASKS, SHORTEST, STRETCH, tolerance

    for n in range(SHORTEST, STRETCH + 1):
        need, allowed = tolerance(n)
        spots = [{o + k for k, c in enumerate(m) if c == "1"} for m in (MASKS if n >= STRETCH else SHORT_MASKS) for o in range(need - len(m) + 1)]
        for bad in itertools.combinations(range(need), allowed):
            assert any(not spot & {*bad} for spot in spots)


def leak_rows(texts, items):
    """(text number, item id, word in the text, word in the item, words, equal words), word by word."""
    out = []
    for d, a in enumerate(texts):
        for item, b in items.items():
            need, allowed = (13, 2) if len(b) >= 13 else (len(b), int(len(b) >= 8))
            every = []
            for shift in range(-len(b) + need, len(a) - need + 1) if len(b) >= 5 else ():
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                same = [a[k + shift] == b[k] for k in range(lo, hi)]
                covered = sorted({k for s in range(len(same) - need + 1) if sum(same[s : s + need]) >= need - allowed for k in range(s, s + need)})
                starts = [s for s in range(len(same) - need + 1) if sum(same[s : s + need]) >= need - allowed]
                runs = []
                for s in starts:
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = s + need
                    else:
                        runs.append([s, s + need])
                assert sum(e - s for s, e in runs) == len(covered)
                every += [(-sum(same[s:e]), s + lo + shift, s + lo, e - s) for s, e in runs]
            taken = []
            for equal, at, of, n in sorted(every):
                if all(at + n <= s or e <= at for s, e in taken):
                    taken.append((at, at + n))
                    out.append((d, item, at, of, n, -equal))
    return out


def test_leaks_match_brute_force(spark):
    """Items of all lengths with substitutions at every place, items shared in two pieces, repeated words, items without an id."""
    from skein.llm.decontaminate import find_leaks

    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (3, 5, 7, 8, 9, 10, 11, 12, 13, 14, 60)}
    items |= {200: ["same"] * 20, 300: "a b a b a b a b a b a b a b a b".split()}
    texts = [["same"] * 40, "x a b a b a b a b a b a b a b y".split(), items[60][:13] + ["other"] * 30 + items[60][-13:], items[60] * 2, []]
    for n in (5, 7, 8, 9, 10, 11, 12, 13, 14):
        texts += [["before", *items[n][:k], "gone", *items[n][k + 1 :], "after"] for k in range(n)] + [["x", *items[n]]]
    for k, j in itertools.combinations(range(14), 2):
        texts.append([w if m not in (k, j) else "gone" for m, w in enumerate(items[14])])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(None if i == 12 else i, " ".join(w).upper()) for i, w in items.items()] + [(900, " ".join(items[60])), (901, None)], "item_id long, text string")
    want = ordered((d, None if i == 12 else i, *rest) for d, i, *rest in leak_rows(texts, items))
    for block in (32 << 20, 100):
        assert ordered(map(tuple, find_leaks(docs, bench, block_bytes=block).collect())) == want


def test_words_that_recur_thousands_of_times(spark):
    from skein.llm.decontaminate import block_of

    text = b"same " * 6000
    assert block_of([(1, text)]).leaks([text]) == [[(1, 0, 0, 6000, 6000)]]


def test_leaks(spark, docs, rows, empty):
    from skein.llm.decontaminate import decontaminate, find_leaks
    from skein.llm.toxicity import words_of

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()][:10] + [(900, None), (901, "too short"), (902, " ".join(f"w{k}" for k in range(20, 50)))]
    planted = items[0][1].split()
    planted[3] = planted[9] = "swapped"
    more = spark.createDataFrame([(5000, "before that " + " ".join(planted[:13]) + " after", "a", "", "")], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t, _ in [*rows, (5000, more.first().text, "a")]:
        a = words_of((t or "").encode())
        for item, text in items:
            b = words_of((text or "").encode())
            need, allowed = (13, 2) if len(b) >= 13 else (len(b), int(len(b) >= 8))
            if need >= 5 and any(sum(x != y for x, y in zip(a[p : p + need], b[q : q + need])) <= allowed for p in range(len(a) - need + 1) for q in range(len(b) - need + 1)):
                want.add((i, item))
    for block in (32 << 20, 300):
        got = [(r.doc_id, r.item_id) for r in find_leaks(docs.unionAll(more), bench, block_bytes=block).collect()]
        assert {*got} == want and (5000, items[0][0]) in want
    left = decontaminate(docs.unionAll(more), bench)
    assert left.columns == docs.columns
    assert left.count() == sum((i, ) not in {(d,) for d, _ in want} for i, _, _ in [*rows, (5000, "", "")])
    assert find_leaks(empty, bench).count() == find_leaks(docs, bench.limit(0)).count() == 0


def test_secrets(docs, rows, empty):
    from skein.llm.secrets import digest, redact, scan_secrets

    kinds = {"assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
    want = []
    for i, t, _ in rows:
        found = [(m.start(), k, m.end(), name) for k, (name, (p, g, n)) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if len(m.group(g)) >= n]
        base = ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(found))
        want.append((i, *(sum(f[3] == n for f in found) for n in kinds), hashlib.sha256(base.encode()).hexdigest()))
    scanned = digest(scan_secrets(docs)).collect()
    assert ordered((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in scanned) == ordered(want)
    assert any(r.doc_id == 1101 and "issued:" in r.spans for r in scanned)
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert "abcdefgh12" not in clean[1100] and clean[1004] == "a b" and clean[1000] is None
    assert digest(scan_secrets(empty)).count() == 0


def test_widely_copied_secrets_are_not_live(spark):
    from skein.llm.secrets import scan_secrets

    rows = [(k, "password=samesame1", f"s{k}", "", "") for k in range(5)] + [(9, "password=onlymine9", "s1", "", "")]
    live = {r.doc_id: len(r.live) for r in scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert live == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 1}


def test_secrets_in_texts_with_thousands_of_matches(spark):
    """Patterns on megabyte texts, and places after many matches; time doesn't grow with their square."""
    import time

    from skein.llm.secrets import KINDS, digest, redact, scan_secrets

    dump = " ".join(f"{k:032x}" for k in range(20_000))
    texts = [dump, "-----BEGIN " + "A " * 5000, "-----BEGIN RSA PRIVATE KEY-----" + "ab " * 300_000, "password=" + "a" * 1_000_000, "eyJ" + "a" * 500_000, "AKIA" * 200_000, "x" * 1_000_000]
    d = spark.createDataFrame([(k, x, f"s{k}", "", "") for k, x in enumerate(texts)], SCHEMA)
    began = time.time()
    got = {r.doc_id: r for r in digest(scan_secrets(d)).collect()}
    assert time.time() - began < 120
    assert got[0].spans.split(",")[-1] == f"hex:{33 * 19_999}:{33 * 20_000 - 1}" and got[0].n_hex == 20_000
    assert got[1].spans == "" and got[2].spans.startswith("pem:0:") and got[3].n_assign == 1 and got[5].n_access == 1
    assert len(KINDS) == 6 and {r.doc_id: r.text for r in redact(d).collect()}[0] == " ".join(["<secret>"] * 20_000)


def test_columns_of_any_name_come_along(spark):
    from skein.llm.jaccard_join import keep_first
    from skein.llm.secrets import redact

    names = ["live", "live_text", "live_id", "lost_id", "lost_text", "row", "masked", "redacted_text", "hash"]
    text = "password = hunter2hunter2 and so on"
    d = spark.createDataFrame([(1, text, "a", *names), (2, text, "a", *names), (3, None, "a", *names)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for out, n in ((redact(d), 3), (keep_first(d), 2)):
        assert out.columns == d.columns
        rows = out.collect()
        assert len(rows) == n and all(r[c] == c for r in rows for c in names)
    assert "hunter2" not in {r.doc_id: r.text for r in redact(d).collect()}[1]


def test_keep_first_keeps_blank_rows(spark):
    from skein.llm.jaccard_join import jaccard_classes, keep_first

    schema = "doc_id long, text string, source string"
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "a"), (2, "", "a"), (3, "some words here", "a")]
    for more in ([], [(3, "some words here", "a")], [(3, "some words here", "a"), (None, "some words here", "a"), (None, "some words here", "a")]):
        assert keep_first(spark.createDataFrame(rows + more, schema)).count() == 5
    assert keep_first(spark.createDataFrame([(None, "x y", "a")] * 3, schema)).count() == 1
    assert jaccard_classes(spark.createDataFrame([], schema)).count() == 0


def test_mixing(docs, rows, empty):
    from skein.llm.mixing import curriculum_mix

    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= full
    got = curriculum_mix(docs, keep=("source",)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
    assert all(target[s] - 1 <= taken[s] <= target[s] for s in size)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert curriculum_mix(empty).count() == 0


def test_mixing_places_second_servings(docs, rows):
    """Read in order of position, a source's words taken up to any time are what its ramp demands, in both servings."""
    from skein.llm.mixing import RAMPS, curriculum_mix, curriculum_servings

    got = curriculum_servings(docs, keep=("source",)).collect()
    assert sum(r.serving == 1 for r in got) == len(rows) and sum(r.serving == 2 for r in got) > 0
    assert sum(r.taken for r in got) == sum(r.taken for r in curriculum_mix(docs).collect())
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    done, second = Counter(), Counter()
    for r in got:
        if r.taken:
            a, b = RAMPS[order.index(r.source) % 3]
            t = r.position
            demand = r.target * (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            assert 0 <= t <= 1 and demand == pytest.approx(done[r.source], abs=1e-3)
            done[r.source] += r.taken
            second[r.source] += r.serving == 2
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and sum(second.values()) > 0


def test_url_rules(spark):
    from skein.llm.url_filter import RULES, filter_urls, page_outcomes

    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "http://a.example.com/en/", "https://www.example.com/en/1?q", "http://m.www.example.com/en/2#x", "http://x.net/es/3", "http://x.net/de/4", "http://net/fr/", "http://com", "http://notcom/", "http://bad.org/en/1", "http://bad.org/en/2"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (4, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = {r.page_id: r for r in filter_urls(pages, page_outcomes(pages, labels)).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        if rule:
            assert got[k].verdict == dict(RULES)[rule]
    assert filter_urls(pages.limit(0), page_outcomes(pages.limit(0), labels)).count() == 0
    assert filter_urls(pages, page_outcomes(pages, labels.limit(0))).count() == len(urls)


def test_reputation_matches_brute_force(spark):
    """Counts, strengths, priors and the posterior's quantile in plain Python; verdicts by host, joined in both ways."""
    from skein.llm.url_filter import RULES, filter_urls, page_outcomes, reputations

    def domain(h):
        parts = h.split(".")
        if re.fullmatch("[0-9.]+", h):
            return h, parts[-1]
        two = len(parts) > 1 and parts[-2] in ("co", "com", "org") and len(parts[-1]) == 2
        return ".".join(parts[-3 if two else -2 :]), ".".join(parts[-2 if two else -1 :])

    names = [f"h{k}.d{k % 7}.{('org', 'info', 'co.uk', 'biz')[k % 4]}" for k in range(60)] + ["10.0.0.1", "u@h1.d1.info:80"]
    urls, label = [], {}
    for k, h in enumerate(names):
        for j in range(k % 13):
            doc = 100 * k + j
            urls.append(f"http://{h}/en/{doc}")
            if (k + j) % 5:
                label[doc] = int((k * 7 + j) % 11 > (9 if k % 7 < 3 else 2))
        urls.append(f"http://{h}/about")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame(list(label.items()) + [(None, 0)], "doc_id long, quality int")
    n, bad = Counter(), Counter()
    for u in urls:
        site = re.sub(r":[0-9]*$", "", u.split("/")[2].split("@")[-1])
        doc = u.split("/")[-1]
        if doc.isdigit() and int(doc) in label:
            n[site] += 1
            bad[site] += label[int(doc)] == 0
        n[site] += 0
    up = [{h: domain(h)[0] for h in n}, {domain(h)[0]: domain(h)[1] for h in n}]
    level = [(n, bad)]
    for m in up:
        a, b = Counter(), Counter()
        for k in level[-1][0]:
            a[m[k]] += level[-1][0][k]
            b[m[k]] += level[-1][1][k]
        level.append((a, b))

    def strength(groups, parent):
        pn, pb = Counter(), Counter()
        for g in groups[0]:
            pn[parent(g)] += groups[0][g]
            pb[parent(g)] += groups[1][g]
        s = k = t = q = 0
        for g, m in groups[0].items():
            if m:
                p = (pb[parent(g)] + 0.5) / (pn[parent(g)] + 1)
                s, k, t, q = s + m * (groups[1][g] / m - p) ** 2 / (p * (1 - p)), k + 1, t + m, q + m * m
        if k < 2 or t <= k:
            return 10.0
        rho = (s - (k - 1)) / max(t - q / t - (k - 1), 1e-9)
        return min(1000.0, max(1.0, 1 / rho - 1)) if rho > 0 else 1000.0

    ks = strength(level[2], lambda g: 0), strength(level[1], up[1].get), strength(level[0], up[0].get)
    prior = {None: (sum(bad.values()) + 1) / (sum(n.values()) + 2)}
    for (gn, gb), k, parent in ((level[2], ks[0], lambda g: None), (level[1], ks[1], up[1].get)):
        prior |= {("x", g) if parent(g) is None else ("d", g): (gb[g] + k * prior[None if parent(g) is None else ("x", parent(g))]) / (gn[g] + k) for g in gn}
    want = {}
    for h in n:
        m = prior["d", up[0][h]]
        a, b = bad[h] + ks[2] * m, n[h] - bad[h] + ks[2] * (1 - m)
        steps = 20_000
        grid = [(k + 0.5) / steps for k in range(steps)]
        mass = [math.exp((a - 1) * math.log(x) + (b - 1) * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / steps for x in grid]
        low = next(x for x, c in zip(grid, itertools.accumulate(mass)) if c >= 0.05)
        want[h] = (a / (a + b), low)
    for few in (200_000, 3):
        got = {r.page_id: r for r in filter_urls(pages, page_outcomes(pages, labels), broadcast_hosts=few).collect()}
        assert len(got) == len(urls)
        for k, u in enumerate(urls):
            rate, low = want[re.sub(r":[0-9]*$", "", u.split("/")[2].split("@")[-1])]
            assert got[k].host_rate == pytest.approx(rate) and got[k].host_low == pytest.approx(low, abs=2e-3)
            if got[k].rule is None:
                assert got[k].verdict == ("block" if got[k].host_low > 0.25 else "allow")
        assert len({r.verdict for r in got.values()}) == 2


def test_url_columns_match_sql(spark):
    import duckdb

    from skein.llm.queries import op4_url_filter
    from skein.llm.url_filter import EXACT

    pages = f"'{DIR}/pages.parquet'"
    want = duckdb.sql(EXACT.replace("FROM pages", f"FROM {pages}")).fetchall()
    assert ordered(tuple(r)[:4] for r in op4_url_filter(spark, DIR).collect()) == ordered(want)


def test_reputation_shrinks(spark):
    from skein.llm.url_filter import reputations

    hosts = spark.createDataFrame([("bad.x.com", 200, 190), ("one.x.com", 1, 1), ("good.y.com", 300, 3), ("new.y.com", 0, 0)], "site string, n long, bad long")
    r = {x.site: x for x in reputations(hosts).collect()}
    assert r["bad.x.com"].low > 0.8 and r["good.y.com"].rate < 0.05
    assert r["one.x.com"].low < r["bad.x.com"].low and r["new.y.com"].low < r["one.x.com"].low


def test_lm_scores(docs, rows, empty):
    from skein.llm.suffix_tree import score_texts

    lower = lambda t: [w.lower() for w in words(t)] + ["end"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in rows if not held(i) for w in lower(t))
    n, v = sum(counts.values()), len(counts)
    want = [(i, held(i), len(lower(t)), sum(counts[w] > 0 for w in lower(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in lower(t))) for i, t, _ in rows]
    for head in (1_000_000, 50):
        got = score_texts(docs, head=head).collect()
        for a, b in zip(ordered(tuple(r)[:5] for r in got), ordered(w[:5] for w in want), strict=True):
            assert a == b
        base = sorted(round(r.base_score, 4) for r in got)
        assert base == pytest.approx(sorted(round(w[5], 4) for w in want))
        assert head == 50 or sum(r.score for r in got) > sum(r.base_score for r in got)
    assert score_texts(empty).count() == 0


def test_lm_sums_move_by_batch(docs):
    """No row a document and part: the look-ups' sums go in packed rows, and nothing groups them by document."""
    from skein.llm.suffix_tree import score_texts

    plan = score_texts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Generate" not in plan


def test_lm_distributions_sum_to_one(spark, docs):
    import numpy as np

    from skein.llm.suffix_tree import END, plant
    from skein.llm.text import hash_words

    tree, rest, n_rest = plant(docs.select("text").na.fill(""), hot=1 << 40)
    assert n_rest == 0 and len(tree.keys.keys) > 0
    for text in (b"the", b"a a", b"de la"):
        context = hash_words([text])[0]
        total = 0.0
        for w in tree.head.keys:
            h = np.concatenate([context, [w]]).astype(np.uint64)
            _, root, more, _, _ = tree.scores(h, np.array([0, len(h)]))
            total += 10 ** (root + more)[-1]
        assert total + 1 / (tree.n + tree.v + 1) == pytest.approx(1, abs=1e-4)
    assert END in tree.head.keys


def test_lm_tree_grows_with_the_corpus(spark):
    """A context of a few occurrences is a state however many other words there are, held in memory or joined."""
    from skein.llm.suffix_tree import score_texts

    phrase = "red fox ran home"
    texts = [f"{phrase} x{k}" for k in range(12)] + [" ".join(f"f{k % 2}{j}" for j in range(5000)) for k in range(40)]
    rows = [(k, x) for k, x in enumerate(texts)] + [(10_000, phrase), (10_001, "home ran fox red")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{r.doc_id: r for r in score_texts(docs, hold=(1 << 40, 1), hot=hot).collect()} for hot in (1_000_000, 40, 0)]
    for got in found:
        assert got[10_000].base_score == pytest.approx(got[10_001].base_score)
        assert got[10_000].score > got[10_001].score + 6
        assert {k: r.score for k, r in got.items()} == pytest.approx({k: r.score for k, r in found[0].items()})


def test_lm_matches_brute_force(spark, docs, rows):
    """Scores against the tree grown in plain dictionaries, with all, some and none of it broadcast."""
    from skein.llm.suffix_tree import CONTEXT, COST, DISCOUNT, NEXT, score_texts

    lower = lambda t: [w.lower() for w in words(t)] + ["end"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    train = [lower(t) for i, t, _ in rows if not held(i)]
    root = Counter(w for t in train for w in t)
    n, v = sum(root.values()), len(root)
    whole, follow = Counter(), defaultdict(Counter)
    for t in train:
        for k, w in enumerate(t):
            for d in range(1, min(k, 3) + 1):
                whole[tuple(t[k - d : k])] += 1
                follow[tuple(t[k - d : k])][w] += 1
    follow = {c: {w: k for w, k in f.items() if k >= NEXT} for c, f in follow.items() if whole[c] >= CONTEXT}
    follow = {c: f for c, f in follow.items() if f}

    def p(c, w, tree):
        if not c:
            return (root[w] + 1) / (n + v + 1)
        if c not in tree:
            return p(c[1:], w, tree)
        f = tree[c]
        back = max(1e-12, 1 - (sum(f.values()) - DISCOUNT * len(f)) / whole[c])
        return max(f.get(w, 0) - DISCOUNT, 0) / whole[c] + back * p(c[1:], w, tree)

    kept = {}
    for c, f in follow.items():
        if sum(k * math.log(k / whole[c] / p(c[1:], w, follow)) for w, k in f.items()) > COST * len(f):
            for d in range(len(c)):
                kept[c[d:]] = follow[c[d:]]
    want = sorted(sum(math.log10(p(tuple(t[max(k - 3, 0) : k]), w, kept)) for k, w in enumerate(t)) for t in (lower(t) for _, t, _ in rows))
    for options in ({}, {"hot": 300, "head": 50}, {"hot": 0}):
        assert sorted(r.score for r in score_texts(docs, **options).collect()) == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_quality_counts(docs, rows, labels, empty):
    from skein.llm.quality import judge_quality

    want = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    got = judge_quality(docs, labels).collect()
    assert ordered(tuple(r)[:7] for r in got) == ordered(want)
    assert not any(r.kept and r.base_failed for r in got)
    assert judge_quality(empty, labels).count() == 0
    assert all(r.kept != r.base_failed for r in judge_quality(docs, labels.limit(0)).collect())


def test_toxicity(spark, rows, docs, labels, empty):
    from skein.llm.toxicity import reject_toxic, score_toxicity

    clean = ["the river runs slow past green hills and quiet farms in spring", "we walked along the old road and talked about the weather"]
    made = [(k, clean[k % 2] + (f" you stupid moron number {k % 7}" if k % 3 == 0 else f" and more of it {k % 7}"), "a", "", "") for k in range(300)]
    d = spark.createDataFrame(made, SCHEMA)
    y = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = score_toxicity(d, y).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) / len(held) > 0.95
    kept = reject_toxic(d, y)
    assert kept.columns == d.columns and kept.count() == sum(not r.predicted for r in got)
    assert len(score_toxicity(docs, labels).collect()) == len(rows)
    assert score_toxicity(empty, labels).count() == 0
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_training_texts_are_bounded_and_repeatable(spark):
    from skein.llm.training import labelled_texts

    rows = [(1, f"text {k}") for k in range(500)] + [(2, "one"), (3, "x" * 400), (4, "four"), (None, "none")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    found = [labelled_texts(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, "toxic", 10, max_bytes=300) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert found[0] == found[1] and [(i, y) for i, _, y in found[0]] == [(1, 1), (2, 0)]
    assert len(labelled_texts(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", 10, total_bytes=400)) == 2


def test_pipeline_matches_brute_force(spark):
    """Documents after each stage: the toxic by their scores, all else by plain Python."""
    import corpus_pipeline

    from skein.llm.secrets import digest, scan_secrets
    from skein.llm.toxicity import score_toxicity, words_of

    docs, labels = (spark.read.parquet(f"{DIR.replace("0.001", "0.01")}/{x}.parquet") for x in ("documents", "labels"))
    toxic = {r.doc_id for r in score_toxicity(docs, labels).collect() if r.predicted}
    held = {r.doc_id: r for r in docs.collect() if r.doc_id not in toxic}
    sets = dict(zip(held, shingle_sets([(i, r.text, None) for i, r in held.items()])))
    name = {i: i for i in held}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in itertools.combinations(held, 2):
        common = len(sets[a] & sets[b])
        if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((find(a), find(b)))
            name[b] = a
    held = {i: r for i, r in held.items() if find(i) == i}
    items = [words_of(r.text.encode()) for r in spark.read.parquet(f"{DIR.replace("0.001", "0.01")}/benchmark.parquet").collect()]
    short = {}
    for n, b in enumerate(items):
        for q in range(len(b) - 3):
            short.setdefault(tuple(b[q : q + 4]), []).append((n, q))

    def leaks(text):  # 13 words with 2 substitutions hold 4 equal words in a row
        a = words_of((text or "").encode())
        for n, shift in {(n, p - q) for p in range(len(a) - 3) for n, q in short.get(tuple(a[p : p + 4]), ())}:
            b = items[n]
            same = [a[k + shift] == b[k] for k in range(max(0, -shift), min(len(b), len(a) - shift))]
            if any(sum(same[s : s + 13]) >= 11 for s in range(len(same) - 12)):
                return True
        return False

    assert all(len(b) >= 13 for b in items)
    held = {i: r for i, r in held.items() if not leaks(r.text)}
    clean = spark.createDataFrame([*held.values()], docs.schema)
    live = {r.doc_id: r.spans for r in digest(scan_secrets(clean)).collect() if r.n_live}
    got = corpus_pipeline.run(spark, DIR.replace("0.001", "0.01")).collect()
    assert {r.doc_id for r in got} == set(held) and 0 < len(toxic) < docs.count() and live
    size = Counter()
    for r in got:
        assert (r.text == held[r.doc_id].text) == (r.doc_id not in live) and (r.lang, r.source) == (held[r.doc_id].lang, held[r.doc_id].source)
        assert r.size == len(words(r.text)) and r.n_chars == len(r.text or "")
        size[r.source] += r.size * (r.serving == 1)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source]
        taken[r.source] += r.taken
    target = {r.source: r.target for r in got}
    assert all(target[s] - 1 <= taken[s] <= target[s] for s in size) and sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held, out = docs, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, DIR)
        if name != "mixing":
            assert out.columns == docs.columns
            held = out.cache()
            assert 0 < held.count() <= docs.count()
    ids = {r.doc_id for r in out.collect()}
    assert ids == {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()} == {r.doc_id for r in held.collect()}


def test_pipeline_returns_the_masked_texts(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    texts = ['key AKIAABCDEFGHIJKL12 stays "secret" here', "plain words alone", "more words of another source"]
    docs = spark.createDataFrame([(k, x, "en", "ab"[k % 2], len(x)) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    masked = stages["secrets"](spark, docs, DIR)
    got = stages["mixing"](spark, masked, DIR).collect()
    want = {r.doc_id: tuple(r) for r in masked.select("doc_id", "text", "lang", "source", "n_chars").collect()}
    assert want[0][1] != texts[0] and {r.doc_id for r in got} == set(want)
    assert all((r.doc_id, r.text, r.lang, r.source, r.n_chars) == want[r.doc_id] for r in got)
    assert sum(r.serving == 2 for r in got) > 0


def test_arrow_batches_are_bounded_in_bytes(spark):
    """Packed rows are few and wide: a task's rows mustn't go to its worker as one batch."""
    import pyarrow as pa

    from skein.llm.text import small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(x) for x in names]
    wide = spark.range(0, 60, 1, 1).selectExpr("cast(repeat('x', 500000) as binary) as blob")
    try:
        for now, most in ((str(64 << 20), 4 << 20), ("1m", 1 << 20)):  # a smaller limit stays
            spark.conf.set(names[1], now)
            small_batches(spark)
            got = wide.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in got) == 60 and max(r.size for r in got) <= most + 600_000
    finally:
        for x, y in zip(names, before, strict=True):
            spark.conf.set(x, y)


def test_lm_blobs_are_given_up_as_they_are_read():
    import numpy as np

    from skein.llm.packing import Reader, Table, pack, pack_sorted
    from skein.llm.suffix_tree import _taken

    keys = [np.sort(np.random.default_rng(k).integers(0, 1 << 63, 5000, np.uint64)) for k in range(3)]
    readers = [Reader(b"E" + pack_sorted(k) + pack(np.arange(len(k))), 1) for k in keys]
    found, n = _taken(readers, np.int64)
    assert not readers and (found == np.concatenate(keys)).all() and (n == np.tile(np.arange(5000), 3)).all()
    assert [len(x) for x in _taken(None, np.int64)] == [0, 0]
    every = np.unique(found)
    for some in (every, every[:1], every[:0], np.arange(300_000, dtype=np.uint64) << np.uint64(45)):
        place, hit = Table(some).find(every)
        assert (hit == np.isin(every, some)).all() and (some[place[hit]] == every[hit]).all()


def test_lm_entries_are_told_apart_and_look_ups_go_in_rounds(spark):
    """A state and the transition that its last word is are one look-up, however many entries are held, in any number of rounds."""
    import pickle

    import numpy as np

    from skein.llm.packing import Reader, pack_small, take_small
    from skein.llm.suffix_tree import _followed, _pairs, plant, score_texts, tokens

    texts = [" ".join(f"w{(k * j * j + j) % 17}" for j in range(1 + k % 40)) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [{r.doc_id: tuple(r) for r in score_texts(docs, head=head, hot=hot, rounds=rounds).collect()} for head, hot, rounds in ((500, 1 << 40, 1), (500, 60, 1), (9, 60, 3), (9, 0, 2))]
    for got in found[1:]:
        assert len(got) == 300 and all(got[k][:5] == x[:5] and got[k][5:] == pytest.approx(x[5:], abs=1e-8) for k, x in found[0].items())
    tree, _, n_rest = plant(docs.select("text"), hot=1 << 40)
    assert n_rest == 0 and len(tree.keys.keys) == len(np.unique(tree.keys.keys)) and (tree.backs < 0).any() and ((tree.values != 0) & (tree.backs < 0)).any()
    h, starts = tokens([x.encode() for x in texts])
    for x, y in zip(tree.scores(h, starts), pickle.loads(pickle.dumps(tree)).scores(h, starts), strict=True):
        assert np.array_equal(x, y)
    # words after one context whose pairs share the half by which they are sorted are told apart
    code = np.arange(300_000, dtype=np.uint64)
    half = _pairs(np.full(len(code), 1 << 40, np.uint64), code) & np.uint64(0xFFFFFFFF)
    order = np.argsort(half)
    same = np.flatnonzero(half[order][1:] == half[order][:-1])[0]
    twins = np.tile(code[order[same : same + 2]], 50)
    at, n, cut = _followed(np.full(100, 1 << 40, np.uint64), twins)
    assert len(np.unique(twins)) == 2 and [n[twins[at] == x].sum() for x in np.unique(twins)] == [50, 50] and cut.tolist() == [0]
    for some in (np.arange(700), np.arange(9), np.arange(0), np.array([256, 1023, 5, 70_000])):
        r = Reader(pack_small(some) + b"x")
        assert (take_small(r) == some).all() and r.raw[r.at :] == b"x"


def test_pipeline_stages_start_no_extra_workers_and_write_few_files(spark, tmp_path, monkeypatch):
    """Ids chosen for training reach the executors without Python workers of their own, and small tables aren't a file a partition."""
    from pathlib import Path

    from skein.functions.durable import shared_folder
    from skein.llm.jaccard_join import keep_first
    from skein.llm.training import labelled_texts

    made = spark.createDataFrame([(k, " ".join(f"w{k % 20}x{j}" for j in range(30))) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    plain, plans = type(spark).createDataFrame, []

    def noted(self, *args, **kwargs):
        out = plain(self, *args, **kwargs)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", noted)
        assert len(labelled_texts(made, labels, "toxic", 10)) == 20
    assert plans and all("LocalTableScan" in p for p in plans)

    made.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before, parts = {*folder.rglob("part-*")}, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        assert sorted(r.doc_id for r in keep_first(docs).collect()) == [*range(20)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len({*folder.rglob("part-*")} - before) < 64
