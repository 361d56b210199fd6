"""Token alignment against plain loops over bytes."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_operators import CASES, SCHEMA

from tableferry.llm import alignment
from tableferry.llm.production import TOKENIZERS
from tableferry.llm.queries import QUERIES

MORE = [
    (20, "naïve ﬁne ①② 中文字符 한국어 emoji 👩‍👩‍👧 ▁ piece", "en", "s"), (21, "<|endoftext|> and <s> </s> <0x41> <unk>", "en", "s"),
    (22, "  spaces   and\t\ttabs\n\n\nlines \r\n", "en", "s"), (23, "▁", "en", "s"), (24, "a", "en", "s"), (25, " ", "en", "s"),
    (26, "control \x00\x01\x7f and ​ zero ﻿ width \x85 next", "en", "s"), (27, "0123456789" * 30 + "!?" * 40, "en", "s"),
]


def tokens(texts):
    """Ids and token bytes of both tokenizers, straight from the libraries and the files' own rules."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}

    def piece(i):
        byte = re.fullmatch("<0x([0-9A-F]{2})>", b.id_to_piece(i))
        return bytes([int(byte[1], 16)]) if byte else b.id_to_piece(i).replace("▁", " ").encode()

    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [piece(i) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            yield [], [], [], []
        else:
            yield ids_a, ids_b, bytes_a, bytes_b


def brute(texts):
    """Per text: counts, groups as text, overlap links (place a, place b), shared links."""
    out = []
    for ids_a, ids_b, bytes_a, bytes_b in tokens(texts):
        owner_a = [n for n, x in enumerate(bytes_a) for _ in x]
        owner_b = [n for n, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(owner_a, owner_b)))
        ends = [set(np.cumsum([len(x) for x in xs]).tolist()) for xs in (bytes_a, bytes_b)]
        groups, group = [], ([], [])
        for n in range(len(owner_a)):
            for side, owner in zip(group, (owner_a, owner_b)):
                if not side or side[-1] != owner[n]:
                    side.append(owner[n])
            if n + 1 in ends[0] and n + 1 in ends[1]:
                groups.append(group)
                group = ([], [])
        text = ";".join(",".join(str(ids_a[x]) for x in g) + "|" + ",".join(str(ids_b[x]) for x in k) for g, k in groups)
        shared = sorted((x, y) for g, k in groups for x in g for y in k) if len(owner_a) < 5000 else None
        out.append((ids_a, ids_b, groups, text, links, shared))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None, "clash", 7, "clash") for i, t, lang, s in CASES + MORE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_alignment_matches_plain_loops(docs, monkeypatch):
    monkeypatch.setattr(alignment, "STEP_BYTES", 1000)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(alignment, "BLOCK", 500)
    texts = [t for _, t, _, _ in CASES + MORE]
    expected = brute(texts)
    counts = Counter((a[x], b[y]) for a, b, _, _, links, _ in expected for x, y in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = []
    for (i, *_), (a, b, groups, text, links, shared) in zip(CASES + MORE, expected):
        of_links = [counts[a[x], b[y]] for x, y in links]
        n_best = sum(n == best[b[y]] for n, (_, y) in zip(of_links, links))
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        want.append((i, len(a), len(b), len(groups), len(links), n_best, sum(of_links), digest))
    found = alignment.align(docs, TOKENIZERS).collect()
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(repr, ((*(r[c] for c in columns[:6]), int(r.count_sum), r.groups_sha256) for r in found))) == sorted(map(repr, want))
    by_id = {i: len(shared) for (i, *_), (*_, shared) in zip(CASES + MORE, expected) if i is not None and shared is not None}
    assert all(r.n_shared == by_id[r.doc_id] for r in found if r.doc_id in by_id)
    assert sum(not a for a, *_ in expected) >= 5 and any(i == 23 and not a for (i, *_), (a, *_) in zip(CASES + MORE, expected))


@pytest.mark.parametrize("shared", [False, True])
def test_token_links(docs, shared):
    expected = [
        (i, x, y, a[x], b[y])
        for (i, *_), (a, b, _, _, links, groups) in zip(CASES + MORE, brute([t for _, t, _, _ in CASES + MORE]))
        if i not in (6, 7)
        for x, y in (groups if shared else links)
    ]
    found = alignment.token_links(docs.filter("doc_id IS NULL OR doc_id NOT IN (6, 7)"), TOKENIZERS, shared=shared)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))


def test_products_match_dense_matrices(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    rng = random.Random(3)
    for _ in range(50):
        rows, inner, cols = (rng.randint(1, 9) for _ in range(3))
        dense = [np.array([[rng.random() < 0.3 for _ in range(n)] for _ in range(m)]) for m, n in ((rows, inner), (inner, cols))]
        sparse = [
            alignment.Csr(np.concatenate(([0], np.cumsum(d.sum(axis=1)))), np.nonzero(d)[1], d.shape[1]) for d in dense
        ]
        found = {(int(x), int(y)) for row, column in alignment.product(*sparse) for x, y in zip(row, column)}
        assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(dense[0].astype(int) @ dense[1].astype(int)))))
        back = sparse[0].transposed()
        assert [sorted(back.idx[s:e].tolist()) for s, e in zip(back.ptr, back.ptr[1:])] == [np.flatnonzero(c).tolist() for c in dense[0].T]


def test_fallback_gives_the_same_ids():
    both = alignment.Tokenizers(*alignment.vocabulary_files(TOKENIZERS))

    class Broken:
        def encode_ordinary(self, text):
            raise ValueError(text)

    texts = [t.encode() for _, t, _, _ in CASES[:6] + MORE if t]
    plain = [both.encode(t) for t in texts]
    both._a = Broken()
    assert [[x.tolist() for x in both.encode(t)] for t in texts] == [[x.tolist() for x in pair] for pair in plain]
    assert [len(x) for x in both.encode(b"\xff bad bytes")] == [0, 0]


def test_empty_table(docs, spark, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op12_token_alignment"](spark, str(tmp_path)).count() == 0
    assert alignment.token_links(docs.limit(0), TOKENIZERS).count() == 0
