"""Token alignment, prefix tries and repeated substrings against brute force in plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from thalweg.llm import alignment, prefixtrie, substrings
from thalweg.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def prose(seed, n, words=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiéß") for _ in range(rng.randint(1, 8))) for _ in range(words)]
    return ["\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(2, 12))).capitalize() + rng.choice(".,!?") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def aligned(texts):
    """Plain Python: groups by common ends, links by comparing each pair of tokens of a group."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(vocabulary(A)), sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    a.encode_special_tokens = True
    letters, docs, count = alignment.byte_of_letter(), [], Counter()
    for t in texts:
        docs.append(None)
        if not t:
            continue
        ids, other = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        own = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]
        theirs = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in other]
        if not b"".join(own) == b"".join(theirs) == (" " + t).encode():
            continue
        ends, stops = np.cumsum([*map(len, own)]).tolist(), np.cumsum([*map(len, theirs)]).tolist()
        groups, links, i, j = [], [], 0, 0
        for c in sorted({*ends} & {*stops}):
            m, n = ends.index(c, i) + 1, stops.index(c, j) + 1
            groups.append(",".join(map(str, ids[i:m])) + "|" + ",".join(map(str, other[j:n])))
            links += [(ids[x], other[y]) for x in range(i, m) for y in range(j, n) if max(ends[x] - len(own[x]), stops[y] - len(theirs[y])) < min(ends[x], stops[y])]
            i, j = m, n
        count.update(links)
        docs[-1] = len(ids), len(other), len(groups), links, ";".join(groups)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(count[p] == most[p[1]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) for d in docs], count


HARD = [None, "", " ", "  ", "\n", "a\n\n b", "x" * 3000, "a▁b", "a  b   c", "<|endoftext|> a <s> b</s>", "it's don't 'S  \t x", "０１ ﬀ 漢字", "é. É,ß;ñ!\n\n\n  end  ", "\x00\x01 tail ", "é a​b", "nbsp\xa0 b  c", "word " * 20_000]


@pytest.mark.parametrize("limit", [alignment.PAIRS, 0])
def test_alignment(spark, small_batches, limit):
    rng = random.Random(1)
    texts = prose(4, 60) + HARD + HARD[:9] + ["".join(rng.choice("ab .,\n\t'é漢1 ") for _ in range(40)) for _ in range(100)]
    want, count = aligned(texts)
    docs = spark.createDataFrame([(i % 150 if i % 40 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, pair int, n int").repartition(5)
    got = alignment.align(spark, docs, vocabulary(A), vocabulary(B), limit)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter((i % 150 if i % 40 else None, *w) for i, w in enumerate(want))
    if limit:
        assert {(r.a_id, r.b_id): r.n for r in alignment.links(spark, docs, vocabulary(A), vocabulary(B)).collect()} == count


def test_alignment_forgets_units(spark, monkeypatch):
    """What a worker keeps is bounded; results don't depend on it."""
    known = alignment.Aligner(vocabulary(A), vocabulary(B))
    texts = prose(7, 30)
    seen = []
    for keep in (10**9, 5):
        monkeypatch.setattr(alignment, "KEEP", keep)
        monkeypatch.setattr(alignment, "CHUNK", 100)
        known.forget()
        out = []
        for _, row, ends in known.parts(texts):
            out += [[int(c[r].sum()) for c in known.sizes] for r in np.split(row, ends[:-1])]
            out += known.written(row, ends)
            if known.full:
                known.forget()
        seen.append(out)
    assert sorted(map(str, seen[0])) == sorted(map(str, seen[1])) and len(seen[0]) == 2 * len(texts)


def test_components_are_the_smallest_groups():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 40)
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})) for _ in range(2))
        u, v = alignment.linked(a, b)
        root = alignment.united(len(a) + len(b), u, len(a) + v)
        assert len(set(root.tolist())) == len({*a.tolist()} & {*b.tolist()})
        assert all(root[i] == root[len(a) + j] for i, j in zip(u, v))


def test_alignment_of_nothing(spark):
    assert alignment.align(spark, spark.createDataFrame([], "doc_id long, text string"), vocabulary(A), vocabulary(B)).count() == 0


def trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    members, kids = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole = turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:]
        for i in range(len(whole) + 1):
            members[tuple(whole[:i])].append((c, len(whole) == i))
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(k[-1][1]) * (len(members[k]) - 1) if k else 0)
    digest = lambda m: hashlib.sha256(",".join(str(c) for c in sorted(c for c, ends in m if ends)).encode()).hexdigest()
    return Counter((min(c for c, _ in m), len(k), min(c for c, _ in members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], digest(m)) for k, m in members.items())


def conversations(n, long, seed=2):
    rng = random.Random(seed)
    rows = [(c * 7, t if rng.random() > 0.1 else None, rng.choice(["u", "a", None]), rng.choice(["x", "y", "zé", None])) for c in range(n) for t in range(rng.choice([1, 1, 2, 3, 5, 8, 12]))]
    rows += [(700, None if k < 20 else k, "u", f"t{k % 5}") for k in range(long)] + [(None, 1, "u", "x"), (-5, 0, "u", "x"), (-205, 3, "u", "x")]
    return rows + rows[:10]


@pytest.mark.parametrize(("n", "long"), [(120, 900), (20, 0)])
def test_prefix_trie(spark, small_batches, monkeypatch, n, long):
    """Also one conversation with most of the turns, over several ranges and blocks, and ids in several pieces."""
    monkeypatch.setattr(prefixtrie, "BLOCK", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    rows = conversations(n, long)
    given = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, k1 int, path string").repartition(5)
    assert Counter(map(tuple, prefixtrie.trie(spark, given).collect())) == trie(rows)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_trie_of_copies(spark):
    rows = [(c, t, "u", f"t{t}" * 9) for c in range(600) for t in range(3)]
    got = prefixtrie.trie(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert Counter(map(tuple, got.collect())) == trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "u", "x")], [(5, 0, "u", "x")]])
def test_prefix_trie_of_little(spark, rows):
    got = [tuple(r) for r in prefixtrie.trie(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    none = hashlib.sha256(b"").hexdigest()
    assert Counter(got) == (trie(rows) if rows and rows[0][0] is not None else Counter([(None, 0, None, 0, 0, 1, 0, none)]))


def repeats(rows, window=13):
    words = [(-(2**63) if d is None else d, d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for order, _, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(order, least.get(k, order))
    out = Counter()
    for order, d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < order:
                gone[i : i + window] = [True] * window
        out[d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    return out


def passages(seed):
    """Texts that share passages with other neighbours, copies, and texts that repeat themselves."""
    rng, texts = random.Random(seed), prose(seed, 40, 2000)
    shared = [" ".join(prose(seed + 1 + k, 1, 2000)[0].split()[: rng.randint(8, 40)]) for k in range(12)]
    for _ in range(60):
        t = rng.choice(texts).split(" ")
        for _ in range(rng.randint(1, 3)):
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(shared).split(" ")
        texts.append(" ".join(t))
    texts += [" ".join("ab"[k % 2] for k in range(n)) for n in (400, 50, 13, 12)] + [" ".join(rng.choice("xy") for _ in range(60)) for _ in range(80)]
    return texts + texts[:20] + [None, "", " \n\t ", "w\xa0x " * 40, "long " * 30_000]


@pytest.mark.parametrize("seed", [5, 9])
def test_repeated_substrings(spark, small_batches, seed):
    texts = passages(seed)
    rng = random.Random(seed)
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    rows = [(None if i % 37 == 0 else i // 2 if i > 150 else i, t) for i, t in zip(ids, texts, strict=True)]  # null and equal ids
    docs = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, s int, removed string").repartition(6)
    got = substrings.dedup_substrings(spark, docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == repeats(rows)
    assert all(r.n_removed == sum(x.e - x.s for x in r.removed) and r.s == 1 for r in got)
    assert all(x.e - x.s >= 13 for r in got for x in r.removed)


def test_repeats_in_whole_slices(spark):
    """The same where a slice holds many documents, which settle among themselves first; and with shorter windows."""
    rows = [*enumerate(passages(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for window, seed in ((13, 5), (6, 3)):
        got = substrings.dedup_substrings(spark, docs, window, seed).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == repeats(rows, window)


def test_repeats_in_nothing(spark):
    assert substrings.dedup_substrings(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
