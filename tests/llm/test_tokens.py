"""Token counts, byte-level BPE and packing against the plain definitions."""

import base64
from collections import defaultdict

import numpy as np
import pytest

from amperoute.llm import byte_bpe, packing, token_count

from .conftest import prose, public, texts

RANKS = public.path("byte_bpe_50k.tiktoken")
WORDS = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(RANKS, "rb"))}


def greedy(word, pieces):
    n = 0
    while word:
        word = word[next(k for k in range(len(word), 0, -1) if word[:k] in pieces) :]
        n += 1
    return n


def test_automaton_counts_as_greedy_matching_does(ranks):
    automaton = token_count.Automaton(ranks)
    for word in {w for seed in range(20) for w in prose(seed, 200).split()}:
        assert automaton.count(b" " + word.encode()) == greedy(b" " + word.encode(), ranks)
    small = token_count.Automaton([b"a", b"ab", b"abcd", b"c", b"bc"])
    assert [small.count(w) for w in (b"abc", b"abcd", b"abab", b"abcabcd", b"")] == [2, 1, 2, 3, 0]
    with pytest.raises(ValueError):
        small.count(b"abx")


def test_token_counts_of_every_row(docs, empty, ranks):
    got = sorted((r.row.doc_id or -1, r.n_words, r.n_tokens) for r in token_count.count_tokens(docs, RANKS).collect())
    split = [(i or -1, (t or "").encode().split()) for i, t in texts()]
    assert got == sorted((i, len(w), sum(greedy(b" " + x, ranks) for x in w)) for i, w in split)
    assert token_count.count_tokens(empty, RANKS).count() == 0
    by = token_count.tokens_by(token_count.count_tokens(docs, RANKS), "row").collect()
    assert [(r.docs, r.n_tokens) for r in by] == [(len(got), sum(n for *_, n in got))]


def test_byte_bpe_equals_the_library_and_decodes_back(docs, empty, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i or -1, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts())
    trip = byte_bpe.round_trip(docs, RANKS, public.PATTERN).collect()
    assert sorted((r.row.doc_id or -1, [int(x) for x in r.ids.split()], bytes(r.bytes)) for r in trip) == want
    encoded = byte_bpe.encode(docs, RANKS, public.PATTERN)
    assert sorted((r.row.doc_id or -1, r.ids) for r in encoded.collect()) == [(i, ids) for i, ids, _ in want]
    back = byte_bpe.decode(encoded, RANKS, public.PATTERN).collect()
    assert sorted((r.row.row.doc_id or -1, bytes(r.bytes)) for r in back) == [(i, b) for i, _, b in want]
    assert byte_bpe.round_trip(empty, RANKS, public.PATTERN).count() == 0


def test_byte_bpe_cuts_only_where_no_word_spans(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(RANKS, public.PATTERN)
    for text in ("a  b", " a", "a ", " ", "a \n b", "a\n b", "a \tb c", "x y z", "x   y", "a\x0b b", "one two\nthree four"):
        assert np.frombuffer(b"".join(ids for ids, _ in codec.parts([text])[0]), "<u4").tolist() == library.encode_ordinary(text)


def pieces_of(frame):
    rows = packing.pack(frame, WORDS).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    return rows, by_doc, by_sequence


def test_packing_places_every_id_once_without_padding(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    rows, by_doc, by_sequence = pieces_of(docs)
    wanted = defaultdict(list)
    for i, t in texts():
        wanted[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID])
    for doc, pieces in by_doc.items():
        ids = [i for r in sorted(pieces, key=lambda r: r.start) for i in np.frombuffer(r.ids, "<u4").tolist()]
        assert sorted(ids) == sorted(i for one in wanted[doc] for i in one)
        if len(wanted[doc]) == 1:
            assert ids == wanted[doc][0] and {r.doc_tokens for r in pieces} == {len(ids)}
    assert set(by_doc) == set(wanted)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4
            at += r.length
        assert at & (at - 1) == 0 and at <= 4096 and {r.window for r in pieces} == {at}
    assert packing.pack(empty, WORDS).count() == 0


def test_packing_reads_special_tokens_as_the_library_does():
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    for text in ("a <|endoftext|> b", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "plain words only", "<|startoftext|> x\n<|endoftext|>"):
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [320, 49407, 321]


def test_plan_closes_windows_of_all_tiers_and_steps_are_balanced():
    import random

    rng = random.Random(5)
    for _ in range(60):
        lengths = [rng.choice([1, 255, 256, 257, 4096, 9001, rng.randint(1, 5000)]) for _ in range(rng.randint(1, 50))]
        windows = packing.plan(lengths)
        sizes = [sum(n for *_, n in w) for w in windows]
        assert sum(sizes) == sum(lengths) and all(s & (s - 1) == 0 for s in sizes)
        taken = sorted((d, s, n) for w in windows for d, s, n in w)
        for d, length in enumerate(lengths):
            at = 0
            for _, s, n in (x for x in taken if x[0] == d):
                assert s == at
                at += n
            assert at == length
    groups = packing.steps(windows, 8192)
    loads = [sum(s for s, g in zip(sizes, groups, strict=True) if g == k) for k in set(groups)]
    assert max(loads) - min(loads) <= 4096
