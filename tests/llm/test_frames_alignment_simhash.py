"""Operators 11 to 13 against plain Python versions, on given documents and on odd rows."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from strata.llm import fim_frames, simhash, token_alignment
from strata.llm.fim_frames import Frames, fill_in_middle, frame_texts, plan_cuts
from strata.llm.simhash import linked_prints, simhash_components
from strata.llm.token_alignment import Aligner, Fragment, align_tokenizers, compose
from strata.session import cut

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 11 ------------------------------------------------------------------------------------------


def plain_fim(key, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (key, len(units), "plain", None, None, sha(text), sha(text), text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (key, len(units), form, len(p), len(m), sha(out), sha(text), out)


def fim_rows(df, frame_bytes):
    stored = frame_texts(df, carry=["doc_id"], frame_bytes=frame_bytes)
    return sorted(map(tuple, fill_in_middle(plan_cuts(stored, "doc_id"), ["doc_id"], with_output=True).collect()), key=str)


@pytest.mark.parametrize("frame_bytes", [fim_frames.FRAME_BYTES, 48])
def test_fim_of_given_documents(documents, document_rows, frame_bytes):
    want = sorted((plain_fim(r["doc_id"], r["text"]) for r in document_rows), key=str)
    assert fim_rows(documents, frame_bytes) == want


@pytest.mark.parametrize("frame_bytes", [fim_frames.FRAME_BYTES, 5])
def test_fim_of_odd_rows(spark, odd, nothing, frame_bytes):
    rows = [(20, "a<M>b\nc"), (21, "\n"), (22, "\n\n\n"), (23, "x"), (24, "é\n日本\n\U0001f600"), (25, "<\nP>\n<S\n>"),
            (25, "same key\nother text"), (None, "no key\nhere"), (26, "<" * 9 + "\n" + "<S<M<P\n" * 3)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    if frame_bytes == 5:  # a long text in frames of five bytes only costs time
        df = df.where("coalesce(length(text), 0) < 10000")
    got = fim_rows(df, frame_bytes)
    assert got == sorted((plain_fim(r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert fim_rows(nothing, frame_bytes) == []


def test_fim_percentages(documents):
    stored = frame_texts(documents, carry=["doc_id"])
    forms = {p: {r.form for r in plan_cuts(stored, "doc_id", fim_percent=p[0], spm_percent=p[1]).collect()}
             for p in ((0, 50), (100, 0), (100, 100))}
    assert forms[0, 50] == {"plain"}
    assert forms[100, 0] <= {"plain", "psm"} and "psm" in forms[100, 0]
    assert forms[100, 100] <= {"plain", "spm"} and "spm" in forms[100, 100]


def test_only_cut_frames_are_opened():
    raw = "".join(f"line {i}\n" for i in range(4000)).encode()
    opened = []

    class Watched(Frames):
        def raw(self, f):
            opened.append(f)
            return super().raw(f)

    frames = Watched.of([raw], 1000)
    assert frames.units_end(0, 4000) == (0, 0) and frames.units_end(4000, 4000) == (len(raw), len(raw)) and not opened
    end, chars = frames.units_end(1234, 4000)
    assert raw[:end].count(b"\n") == 1234 and chars == end and len(set(opened)) == 1
    assert b"".join(frames.stream(17, 5005)) == raw[17:5005]
    assert frames.find(b"line 999\n", 0) == raw.find(b"line 999\n")


def test_extra_columns_survive(odd):
    out = frame_texts(odd)
    assert {"lang", "n_words", "key", "whole_text"} <= set(out.columns) and out.columns.count("n_chars") == 1
    cols = fill_in_middle(plan_cuts(out, "doc_id"), ["doc_id", "whole_text", "key", "kept"])
    assert cols.columns[:4] == ["doc_id", "whole_text", "key", "kept"]
    assert cols.count() == odd.count()


# -- 12 ------------------------------------------------------------------------------------------


def plain_alignment(rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = token_alignment._byte_alphabet()
    found, count = [], Counter()
    for key, text in rows:
        text = text or ""
        e = tok.encode(" " + text, add_special_tokens=False)
        b = sp.encode(text)
        bytes_a = [bytes(byte_of[c] for c in t) for t in e.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                   for p in (sp.id_to_piece(i) for i in b)]
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append((key, None))
            continue
        ids, ends_a, ends_b = e.ids, _running(bytes_a), _running(bytes_b)
        groups, i, j = [], 0, 0
        for c in sorted(set(ends_a) & set(ends_b)):
            ga, gb = [], []
            while i < len(ids) and ends_a[i] <= c:
                ga.append(ids[i])
                i += 1
            while j < len(b) and ends_b[j] <= c:
                gb.append(b[j])
                j += 1
            groups.append((ga, gb))
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        count.update(set(links))
        found.append((key, (len(ids), len(b), groups, links)))
    top = defaultdict(int)
    for (x, _), c in count.items():
        top[x] = max(top[x], c)
    out = []
    for key, f in found:
        if f is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), sha(text)))
    return sorted(out, key=str)


def _running(parts):
    out, n = [], 0
    for p in parts:
        n += len(p)
        out.append(n)
    return out


def alignment_rows(df):
    return sorted(map(tuple, align_tokenizers(df, A, B, carry=["doc_id"]).collect()), key=str)


def test_alignment_of_given_documents(documents, document_rows):
    assert alignment_rows(documents) == plain_alignment([(r["doc_id"], r["text"]) for r in document_rows])


@pytest.mark.parametrize("range_bytes", [token_alignment.RANGE_BYTES, 96])
def test_alignment_of_odd_rows_and_ranges(spark, odd, nothing, monkeypatch, range_bytes):
    monkeypatch.setattr(token_alignment, "RANGE_BYTES", range_bytes)
    rows = [(30, "a▁ b"), (31, "日本語テキスト" * 60), (32, " \n\t a  b　 d<|endoftext|> </s> 's it's"),
            (33, "foo bar 　x\n" * 40), (34, "ab cd " * 60 + "▁" + " ef" * 30), (35, " " * 300 + "a"),
            (36, "é ü — “x” … y <0x41> " * 30), (36, "second text of the key " * 20)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    if range_bytes == 96:  # the long texts in thousands of ranges only cost time
        df = df.where("coalesce(length(text), 0) < 10000")
    assert alignment_rows(df) == plain_alignment([(r["doc_id"], r["text"]) for r in df.collect()])
    assert alignment_rows(nothing) == []


def test_fragments_form_a_monoid():
    r = random.Random(5)
    aligner = Aligner(A, B)
    text = " ".join("".join(r.choice("abcé日\n'1") for _ in range(r.randrange(1, 9))) for _ in range(60))
    raw = b" " + text.encode()
    one = aligner.fragment(raw, 0, 0, len(raw)).whole()
    for _ in range(30):
        cuts = sorted(r.sample(range(1, len(raw)), 7))
        parts = [aligner.fragment(raw, 0, lo, hi) for lo, hi in zip([0, *cuts], [*cuts, len(raw)])]
        left = Fragment()
        for p in parts:
            left = left + p
        assert compose(parts).whole() == one and left.whole() == one
        k = r.randrange(1, 7)
        assert compose(parts[:k]) + compose(parts[k:]) == compose(parts)
        assert Fragment() + parts[0] == parts[0] == parts[0] + Fragment()
    assert one.tail == ([], [])
    open_range = Fragment.of([(1, 5)], [(2, 4)])
    assert not open_range.closed and open_range.head == ([1], [2])


def test_alignment_keeps_columns_and_groups(odd):
    out = align_tokenizers(odd, A, B, with_groups=True)
    assert {"lang", "n_words", "key", "whole_text", "groups", "count_sum"} <= set(out.columns)
    for r in out.collect():
        assert r.groups_sha256 == ("" if r.n_a == 0 else sha(r.groups))


# -- 13 ------------------------------------------------------------------------------------------


def plain_print(text, words=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        self.up[self.find(x)] = self.find(y)


def plain_components(rows):
    prints = [(k, plain_print(t)) for k, t in rows]
    distinct, sets = sorted({p for _, p in prints}), Sets()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    for k, p in prints:
        for k2, p2 in prints:
            if k is not None and k == k2:
                sets.join(p, p2)
    least = {}
    for k, p in prints:
        least.setdefault(sets.find(p), []).append(k)
    smallest = {c: min((k for k in ks if k is not None), default=None) for c, ks in least.items()}
    return sorted(((k, f"{p:016x}", smallest[sets.find(p)]) for k, p in prints), key=str)


def component_rows(df):
    return sorted(map(tuple, simhash_components(df).collect()), key=str)


def test_simhash_of_given_documents(documents, document_rows):
    assert component_rows(documents) == plain_components([(r["doc_id"], r["text"]) for r in document_rows])


def test_simhash_of_odd_rows(spark, odd, nothing):
    prose = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(40 + i, " ".join(prose[: 12 - i])) for i in range(12)]
    rows += [(60, "ONE Two\tthree\x0bfour"), (61, "one two three four"), (61, "a text quite different from the others"),
             (62, "a text quite different from the others"), (None, "no key"), (63, "w" * 5000 + " x"), (64, "\x00 \x1f \x85")]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    assert component_rows(df) == plain_components([(r["doc_id"], r["text"]) for r in df.collect()])
    assert component_rows(nothing) == []


@pytest.mark.parametrize("crowd", [simhash.CROWD, 0, 10**9])
def test_links_connect_as_all_pairs_do(spark, crowd):
    r = random.Random(3)
    values = set()
    for _ in range(6):  # dense clouds around a few centres, and chains
        centre = r.getrandbits(64)
        for _ in range(60):
            p = centre
            for b in r.sample(range(64), r.randrange(0, 6)):
                p ^= 1 << b
            values.add(p)
    p = r.getrandbits(64)
    for k in range(0, 64, 4):
        p ^= 0xF << k
        values.add(p)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    links = linked_prints(spark.createDataFrame([(v,) for v in signed], "p long"), crowd).collect()
    mask, got, want = (1 << 64) - 1, Sets(), Sets()
    for a, b in links:
        assert ((a ^ b) & mask).bit_count() <= 4
        got.join(a & mask, b & mask)
    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 4:
                want.join(a, b)
    group = lambda s: sorted(sorted(v for v in ordered if s.find(v) == root) for root in {s.find(v) for v in ordered})
    assert group(got) == group(want)


@pytest.mark.parametrize("most", [1, 2])
def test_ball_values_are_not_broadcast(spark, most):
    r = random.Random(4)
    centres = [r.getrandbits(63) for _ in range(60)]
    values = sorted({c ^ (1 << a) ^ (1 << b) for c in centres for a, b in [r.sample(range(63), 2) for _ in range(4)]})
    links = simhash._stars(cut(spark.createDataFrame([(v,) for v in values], "p long")), most)
    found = links.collect()
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    flips = [0, *(1 << a for a in range(64)), *(1 << a | 1 << b for a in range(64) for b in range(a) if most == 2)]
    at = defaultdict(list)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    for v in values:
        for f in flips:
            at[v ^ f].append(signed(v))
    assert {tuple(x) for x in found} == {(min(s), v) for s in at.values() for v in s if v != min(s)}
    assert len(found) == len(set(found)) > 0


def test_spans_asked_for_again_stay_and_runs_equal_single_spans(monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 8)
    aligner = Aligner(A, B)
    often = [b"alpha", b"beta,", "日本".encode()]
    for k in range(6):
        aligner.trim()
        aligner.learn([*often, *(b"w%d" % (10 * k + i) for i in range(4))])
        if k:
            assert all(s in aligner.index for s in often)
        assert len(aligner.index) <= 8 + 7
    numbers = aligner.learn(often)
    fresh = Aligner(A, B)
    for s, k in zip(often, numbers.tolist()):
        (own,) = fresh.learn([s]).tolist()
        assert aligner.text[k] == fresh.text[own] and aligner.counts[k].tolist() == fresh.counts[own].tolist()
        assert aligner.linked(numbers[numbers == k]).tolist() == fresh.linked(fresh.learn([s])).tolist()
    spans = [*often, b"x\ny", b"plain", b"</s>", b"123", "café".encode()]
    assert aligner._run(spans) is not None and aligner._run([*spans, b"\n", b"z"]) is None
    assert aligner._run(["a▁b".encode(), b"c"]) is None
    for one, each in zip(aligner._run(spans)[:2], aligner._each(spans)[:2]):
        assert all((x == y).all() for x, y in zip(one, each))
    assert aligner._ids([*spans, b"\n", "a▁b".encode()])[2].tolist() == [True] * len(spans) + [True, False]
