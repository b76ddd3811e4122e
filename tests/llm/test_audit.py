"""Fingerprints, source divergence and tokenizer alignment against plain versions."""

import collections
import hashlib
import random
import re

import pytest

from gridlake.llm import alignment, divergence, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __to int, hash long, pack long, term string, n long, rank int"
EXTRA = (1, 7, 7, 7, "x", 7, 7)


def made(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(parts)


def prose(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "and", "river", "Stone", "House", "über", "mañana", "walk,", "light.", "green\n", "x1", "日本", "don't", "ﬁn"]
    return " ".join(r.choice(words) for _ in range(n))


LONG = prose(9, 300)
TEXTS = [None, "", " ", "a", "short one", LONG, LONG, LONG[:900] + prose(3, 20), "x" * 500, "ab" * 700, prose(4, 60), prose(5, 61), "▁ odd", "  two  spaces ", "tab\t and\n line \n", "<|endoftext|><s></s><unk><0x0A>", "é ﬁ １２ \x00\x1c\x85 z", "🙂🙂 zero​width  nbsp"]


# Winnowing -------------------------------------------------------------------------------------


def plain_winnow(text, k, window):
    """Gram by gram and window by window, over whole numbers."""
    m, base = 1 << 64, int(winnowing.BASE)

    def mixed(x):
        x = (x ^ (x >> 33)) * int(winnowing.MIX) % m
        return x ^ (x >> 29)

    k = min(k, len(text))
    if not text:
        return []
    hashes = [mixed(sum(mixed(ord(c) + 1) * pow(base, k - 1 - j, m) for j, c in enumerate(text[i : i + k])) % m) for i in range(len(text) - k + 1)]
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if not out or out[-1][1] != at:
            out.append((hashes[at], at))
    return out


def test_winnow_equals_plain_version(monkeypatch):
    for piece in (1 << 17, 37):
        monkeypatch.setattr(winnowing, "PIECE", piece)
        for text in TEXTS:
            for k, window in ((20, 60), (3, 4), (5, 1), (1, 7)):
                got = winnowing.winnow(text or "", k, window)
                assert list(zip(got[0].tolist(), got[1].tolist())) == plain_winnow(text or "", k, window)


def test_shared_passages_are_found_and_positions_tell_where():
    r = random.Random(2)
    letters = "abcdefgh 12"
    for _ in range(40):
        shared = "".join(r.choice(letters) for _ in range(79))
        a, b = ("".join(r.choice(letters) for _ in range(r.randrange(200))) + shared + "".join(r.choice(letters) for _ in range(50)) for _ in range(2))
        x, y = (dict(zip(*[z.tolist() for z in winnowing.winnow(t)])) for t in (a, b))
        both = set(x) & set(y)
        assert both and all(a[x[h] : x[h] + 20] == b[y[h] : y[h] + 20] for h in both)


def neighbours(rows):
    """Rows downwards by id, nulls last, ties as the operator has them, each with its next one."""
    return {id(r): rows[(i + 1) % len(rows)] for i, r in enumerate(rows)}


@pytest.mark.parametrize("chars", [10**9, 1500, 1])
def test_neighbours_equal_plain_version(spark, chars):
    ids = [3 * i - 20 for i in range(len(TEXTS))]
    rows = list(zip(ids, TEXTS)) + [(None, "no id " * 30), (1 << 60, LONG), ((1 << 60) + 1, LONG + "!")]
    df = made(spark, [(i, t, "en", "s") for i, t in rows])
    got = {r["doc_id"]: r for r in winnowing.compare_neighbours(df, chars=chars).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        prints = [plain_winnow(t, 20, 60) for t in (text, changed, following)]
        sets = [{h for h, _ in p} for p in prints]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert [r["fingerprint"], r["edited_fingerprint"]] == [",".join(f"{h:016x}:{p}" for h, p in x) for x in prints[:2]]
        assert [r["near_edited"], r["near_next"]] == near


def test_neighbours_of_repeated_rows_one_row_and_none(spark):
    rows = [(5, "same text " * 20, None, None)] * 30 + [(5, "other", "en", "s"), (1, None, "en", "s")]
    got = winnowing.compare_neighbours(made(spark, rows), chars=100).collect()
    assert len(got) == 32 and sum(r["near_next"] == 1.0 and r["n_chars"] == 200 for r in got) == 29
    one = winnowing.compare_neighbours(made(spark, [(7, "abcdef", "en", "s")])).first()
    assert (one["near_next"], one["edited_sha256"]) == (1.0, hashlib.sha256(b"abcabc").hexdigest())
    assert winnowing.compare_neighbours(made(spark, rows).limit(0)).count() == 0
    column = made(spark, rows).select(winnowing.fingerprint("text").alias("f"), "text").collect()
    assert all(len(r["f"]) == len(plain_winnow(r["text"] or "", 20, 60)) for r in column)


# Divergence ------------------------------------------------------------------------------------


def plain_divergence(rows, least, top):
    cut = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        found = cut.findall((text or "").translate(lower))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = {s: groups[lang, s] for x, s in groups if x == lang}
        mine = {s: collections.Counter({t: c[t] for t in kept if c[t]}) for s, c in mine.items()}
        whole = sum(mine.values(), collections.Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, c in mine.items():
            pairs = [(o, sum(f(p(c, t), p(x, t)) for t in kept)) for o, x in mine.items() if o != s]
            terms = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found)}
    return out


def divergence_rows():
    r = random.Random(8)
    words = ["the", "The", "naïve", "ÉCOLE", "école", "x1y", "a-b", "日本", "river", "stone", "it's", "deep\x7fend", "nul\x00l", "nb sp"]
    rows = []
    for i in range(400):
        source = r.choice(["hot", "hot", "hot", "b", "c", "", None, "été", f"s{i % 90}"])
        some = words if source == "hot" else words[i % 5 :]
        rows.append((" ".join(r.choice(some) for _ in range(r.randrange(40))), r.choice(["en", "en", "de", None]), source))
    return [*rows, (None, "en", "empty"), ("", "xx", "only"), ("", "xx", "other"), ("once", "yy", "single"), ("\t\n 12", "en", "digits")]


@pytest.mark.parametrize("blocks", [(64, 2048), (4, 3)])
def test_divergence_equals_plain_version(spark, blocks):
    rows = divergence_rows()
    df = made(spark, [(i, t, x, s) for i, (t, x, s) in enumerate(rows)])
    got = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.divergence(df, 10, 4, *blocks).collect()}
    assert got == plain_divergence(rows, 10, 4)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_terms_are_runs_of_letters_and_other_bytes():
    assert divergence.terms("Ab_c1Été\x00x\x7fy z".encode()) == ["ab".encode(), b"c", "Été".encode(), b"x", "y z".encode()]


# Alignment -------------------------------------------------------------------------------------


def plain_align(text):
    """Library encodings, shared ends as a set, overlaps by walking both sequences."""
    t = alignment.tokenizers(None, None)
    if not text:
        return None
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    if not t.agree(text, a, b):
        return None

    def ends(ids, sizes):
        out, n = [], 0
        for i in ids:
            n += len(sizes[i])
            out.append(n)
        return out

    ea, eb = ends(a, t.a_bytes), ends(b, t.b_bytes)
    shared, groups, left, right = set(ea) & set(eb), [], [], []
    i = j = 0
    for e in sorted(shared):
        left, right = [], []
        while i < len(ea) and ea[i] <= e:
            left.append(a[i])
            i += 1
        while j < len(eb) and eb[j] <= e:
            right.append(b[j])
            j += 1
        groups.append((left, right))
    links, i, j = [], 0, 0
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = ea[i], eb[j]
        i, j = i + (x <= y), j + (y <= x)
    return a, b, groups, links


def alignment_rows(texts):
    plain = [plain_align(t) for t in texts]
    counts = collections.Counter(pair for p in plain if p for pair in set(p[3]))
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for p in plain:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = p
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sums = sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links)
        out.append((len(a), len(b), len(groups), len(links), *sums, hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_alignment_equals_plain_version(spark, monkeypatch):
    r = random.Random(6)
    letters = list("aabstE'éÉ \t\n0١!?.日ﬁ🙂") + ["  ", "  ", "▁", "<s>", "<|endoftext|>", "́", "ab ", "don't "]
    texts = TEXTS + ["".join(r.choice(letters) for _ in range(r.randrange(50))) for _ in range(500)]
    rows = [*enumerate(texts), (None, LONG), (3, LONG)]
    want = alignment_rows([t for _, t in rows])
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = collections.Counter((i, *w) for (i, _), w in zip(rows, want))
    df = made(spark, [(i, t, "en", "s") for i, t in rows])
    assert collections.Counter((x["doc_id"], *[x[n] for n in names]) for x in alignment.align(df).collect()) == expected
    # The Python function runs in workers of their own: small limits are tried on the class.
    monkeypatch.setattr(alignment, "PIECE_CHARS", 40)
    monkeypatch.setattr(alignment, "CACHE_CHUNKS", 20)
    for w, f in zip(want, alignment.Aligner().texts([t for _, t in rows])):
        assert f.row() == (*w[:4], w[6])
    assert alignment.align(df.limit(0)).count() == 0


def test_division_finds_all_shared_ends():
    import numpy as np

    r = np.random.default_rng(4)
    for _ in range(200):
        size = int(r.integers(1, 400))
        a, b = (np.append(np.sort(r.choice(np.arange(1, size), int(r.integers(0, size)), replace=False)) if size > 1 else np.empty(0, int), size) for _ in range(2))
        cut_a, cut_b = alignment.divide(a, b, np.array([len(a)]), np.array([len(b)]))
        shared = np.intersect1d(a, b)
        assert a[cut_a].tolist() == shared.tolist() == b[cut_b].tolist()


def test_long_texts_without_shared_ends_or_spaces():
    words = " ".join(prose(1, 400) for _ in range(60))
    for text in (words, "x" * 30_000, "é" * 20_000 + " end"):
        p = plain_align(text)
        f = alignment.Aligner().texts([text])[0]
        assert (f.n_a, f.n_b, f.n_groups, f.n_links) == (len(p[0]), len(p[1]), len(p[2]), len(p[3]))
