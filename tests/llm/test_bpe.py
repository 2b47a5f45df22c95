import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from tallyforge.llm import bpe, token_counts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_ids_and_bytes_equal_the_library(both, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(both, PATH, P.PATTERN).collect())
    want = []
    for r in both.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert got == sorted(want)


def test_extra_columns_are_ignored(odd):
    assert bpe.encode(odd, PATH, P.PATTERN).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_round_trip(both):
    encoded = bpe.encode(both, PATH, P.PATTERN, with_ids=True)
    out = bpe.decode(encoded, PATH).collect()
    assert len(out) == both.count()
    for r in out:
        assert sha(bytes(r.decoded)) == r.decoded_sha256 and len(r.ids) == r.n_tokens


def test_long_words_merge_like_short_ones(library):
    ranks = bpe.ranks(PATH)
    for word in (b"a" * 200, b"antidisestablishment" * 9, "ñandú".encode() * 40, b"x\x00y" * 50):
        assert bpe.merge(word, ranks) == bpe._merge_long(word, ranks) == library.encode_single_piece(word) if hasattr(library, "encode_single_piece") else library._encode_single_piece(word)


def test_empty_table(none):
    assert bpe.encode(none, PATH, P.PATTERN).count() == 0


def test_histogram_and_suffix_sums(both, library):
    sizes = [len(library.encode_ordinary(r.text or "")) for r in both.collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(both, PATH, P.PATTERN)).cache()
    rows = {r.length: r for r in sums.collect()}
    assert set(rows) == set(sizes)
    for n, r in rows.items():
        assert r.docs == sizes.count(n)
        assert r.docs_over == sum(s > n for s in sizes)
        assert r.tokens_over == sum(s for s in sizes if s > n)
        assert r.tokens_kept == sum(min(s, n) for s in sizes)
        assert r.tokens_total == sum(sizes) and r.docs_total == len(sizes)
        assert r.fits == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    limits = [0, 1, 7, 100, 512, 10**6]
    for r in token_counts.truncated_totals(sums, limits).collect():
        assert r.tokens_kept == sum(min(s, r.limit) for s in sizes) and r.docs_over == sum(s > r.limit for s in sizes)
    for r in token_counts.quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r.length == min(n for n in sizes if sum(s <= n for s in sizes) >= r.share * len(sizes))


def test_empty_histogram(none):
    sums = token_counts.suffix_sums(token_counts.histogram(none, PATH, P.PATTERN))
    assert sums.count() == 0
    assert [r.tokens_kept for r in token_counts.truncated_totals(sums, [5]).collect()] == [0]
