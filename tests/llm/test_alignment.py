import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import alignment
from plumbline.llm.alignment import align, op13_token_alignment, pieces_of
from plumbline.llm.packing import _byte_letters

from .odd import empty, odd, odd_rows, rows_of

EVEN = [" a", "a  b", "a ", " ", "\n\n \t\n", "x▁y z", "<s> </s> <unk> <0x41> <|endoftext|> b", "don't  stop\r\n\r\n now 's", "　a b c  d", "\U0001f600 é 漢字 لا", "a\x00b \x1c c", "1234 5678,90", "é ﻿ z​ w", "A" * 3000, "漢" * 500]


def brute(rows):
    """Whole texts through both tokenizers, every overlap by walking both lists."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letter, out, links_of, counts = _byte_letters(), [], [], Counter()
    for i, text in rows:
        links, groups, na, nb = [], [], 0, 0
        if text:
            a = [(k, len(bytes(letter[c] for c in t.id_to_token(k)))) for k in t.encode(" " + text, add_special_tokens=False).ids]
            ids = m.encode(text)
            raw = [bytes([int(m.id_to_piece(k)[3:5], 16)]) if m.is_byte(k) else m.id_to_piece(k).replace("▁", " ").encode() for k in ids]
            if b"".join(raw) == (" " + text).encode():
                b, na, nb = list(zip(ids, map(len, raw))), len(a), len(ids)
                x = y = ex = ey = 0
                left, right = [], []
                while x < na or y < nb:
                    # both pointers stand at tokens that have not been entered, at one end or behind it
                    if ex <= ey and x < na:
                        ex += a[x][1]
                        left.append(a[x][0])
                        x += 1
                    elif y < nb:
                        ey += b[y][1]
                        right.append(b[y][0])
                        y += 1
                    if ex == ey and left and right:
                        groups.append((left, right))
                        left, right = [], []
                pos_a, at = [], 0
                for k, n in a:
                    pos_a.append((at, at + n, k))
                    at += n
                j, at_b, pos_b = 0, 0, []
                for k, n in b:
                    pos_b.append((at_b, at_b + n, k))
                    at_b += n
                for s, e, k in pos_a:
                    while pos_b[j][1] <= s:
                        j += 1
                    z = j
                    while z < nb and pos_b[z][0] < e:
                        links.append((k, pos_b[z][2]))
                        z += 1
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        counts.update(links)
        links_of.append(links)
        out.append([i, na, nb, len(groups), len(links), hashlib.sha256(said.encode()).hexdigest() if links else ""])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(((i, na, nb, g, n, sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha) for (i, na, nb, g, n, sha), links in zip(out, links_of)), key=str), counts


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert found(op13_token_alignment(spark, sf)) == brute([(i, t) for i, t, *_ in rows_of(spark, sf)])[0]


@pytest.mark.parametrize("local_pairs", [3, 1 << 19])
def test_odd(spark, monkeypatch, local_pairs):
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(100 + k, t) for k, t in enumerate(EVEN)]
    extra = spark.createDataFrame(rows[-len(EVEN) :], "doc_id long, text string")
    each, pairs = align(odd(spark).unionByName(extra, allowMissingColumns=True), local_pairs=local_pairs)
    want, counts = brute(rows)
    assert found(each) == want
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == dict(counts)
    each, pairs = align(empty(spark))
    assert each.count() == 0 and pairs.count() == 0


def test_long(spark):
    rows = [(1, " " * 1_200_000), (2, "\n" * 1_200_000), (3, "word " * 200_000)]
    got = {r[0]: r for r in found(align(spark.createDataFrame(rows, "doc_id long, text string"))[0])}
    assert all(r[1] > 0 and r[4] == r[1] + r[2] - r[3] for r in got.values()) and got[3][1] >= 200_000


def test_pieces_are_cut_as_the_whole():
    """Forgetting pieces, small slabs and whole texts as one piece change nothing."""
    tokens = alignment.Tokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    texts = [t for _, t, *_ in odd_rows() if t is None or len(t) < 3000] + EVEN
    one = alignment.Aligner(tokens)
    sums, hashes, each, _ = one.group(texts)
    assert tokens.splits and pieces_of("a b  c d") == ["a", "b  c", "d"]
    one.forget()
    tokens.splits = False
    again = one.group(texts)
    assert (sums == again[0]).all() and hashes == again[1]
    key = lambda x: sorted(zip(x["text"].tolist(), x["pair"].tolist(), x["n"].tolist()))
    assert key(each) == key(again[2])
