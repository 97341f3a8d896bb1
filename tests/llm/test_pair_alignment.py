import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm import pair_alignment as p

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def brute():
    """The rows of (doc_id, text) pairs, link by link, with the libraries' own ids."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    a_bytes = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if b"".join(map(a_bytes, x)) != (" " + text).encode() or b"".join(map(b_bytes, y)) != (" " + text).encode():
            return []
        out, i, j, at = [([], [])], 0, 0, [0, 0]
        while i < len(x) or j < len(y):
            if at[0] == at[1] and out[-1][0]:
                out.append(([], []))
            if at[0] <= at[1]:
                out[-1][0].append(x[i])
                at[0] += len(a_bytes(x[i]))
                i += 1
            else:
                out[-1][1].append(y[j])
                at[1] += len(b_bytes(y[j]))
                j += 1
        return out

    def rows(docs):
        per = [groups(t) for _, t in docs]
        links = [[(x, y) for g in gs for x in g[0] for y in g[1]] for gs in per]
        count = Counter(pair for of in links for pair in set(of))
        best = {}
        for (x, _), n in count.items():
            best[x] = max(best.get(x, 0), n)
        out = []
        for (i, _), gs, of in zip(docs, per, links):
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
            out.append((i, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(of), sum(count[k] == best[k[0]] for k in of),
                        sum(count[k] for k in of), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
        return sorted(out, key=str)

    return rows


def cases(prose):
    rng = random.Random(6)
    docs = [(k, " ".join(prose(k, rng.randrange(1, 120)))) for k in range(40)]
    docs += [(100 + k, "".join(rng.choices("abc eé日本\n\t 12'.,-~😀 ß", k=60))) for k in range(60)]
    docs += [(200, None), (201, ""), (202, "<|endoftext|> <s> </s> <0x41> <unk>"), (203, "has ▁ in it"), (204, "  two  spaces "), (205, "\0\x01﻿"),
             (206, "a" * 5000), (207, " " * 3000 + "x"), (3, docs[3][1]), (3, docs[3][1]), (None, "no id"), (208, "ab12" * 4000), (209, "é ﬁ Å")]
    return docs


@pytest.mark.parametrize("leaf, block", [(1_000_000, 2_000_000), (60, 3000)])
def test_against_brute_force(documents, prose, brute, monkeypatch, leaf, block):
    monkeypatch.setattr(p, "BLOCK", block)
    docs = cases(prose)
    got = p.align(documents(docs), A, B, leaf=leaf, with_groups=True).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == brute(docs)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["groups"])


def test_wide_groups_count_the_same(prose, monkeypatch):
    own = p.tokenizers(A, B)
    ids = [own.encode(t) for _, t in cases(prose)]
    made = [p.Alignment(own, [a for a, _ in ids], [b for _, b in ids]) for _ in range(2)]
    usual = made[0].links()
    monkeypatch.setattr(p, "WIDE", 1)
    assert all((x == y).all() for x, y in zip(usual, made[1].links()))


def test_empty_tables(documents):
    assert p.align(documents([]), A, B).count() == 0
    got = p.align(documents([(1, None), (2, "")]), A, B).collect()
    assert sorted(tuple(r) for r in got) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 70_000):
        keys = rng.choice(1 << 32, n, replace=False).astype(np.uint32)
        made = p.PerfectHash.unpacked(*p.PerfectHash.of(keys).packed())
        assert sorted(made.numbers(keys)) == list(range(n))
        other = rng.choice(1 << 32, 100).astype(np.uint32)
        assert (made.numbers(other) < max(n, 1)).all()
