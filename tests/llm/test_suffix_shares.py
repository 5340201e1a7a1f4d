"""What an owner of the suffix array holds at once does not follow how much of the corpus repeats."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lithograin.llm import suffix

WINDOW = 50
own = random.Random(5)


def _texts() -> dict[int, bytes]:
    words = ["".join(own.choice("abcdefgh") for _ in range(own.randint(2, 7))) for _ in range(60)]
    line = lambda n: " ".join(own.choice(words) for _ in range(n))
    stock, base = line(14), [line(120) for _ in range(8)]
    texts = []
    for _ in range(60):
        edited = " ".join(w if own.random() > 0.07 else own.choice(words) for w in own.choice(base).split(" "))
        texts.append(edited)  # anchors repeat, fragments differ
        texts.append(f"{line(9)} {stock} {line(9)}")  # one passage in many surroundings
        texts.append(line(5) + " " * own.randint(45, 130) + line(5))  # one gram for whole runs
        texts.append("".join(own.choice("ab") for _ in range(120)) + "\0" * 60 + "xyz" * own.randint(10, 40))
    own.shuffle(texts)
    return {i: t.encode() for i, t in enumerate(dict.fromkeys(texts))}


def _brute(texts: dict[int, bytes]) -> set[tuple[int, int]]:
    first, gone = {}, set()
    for doc, text in texts.items():
        for i in range(len(text) - WINDOW + 1):
            if first.setdefault(text[i : i + WINDOW], doc) < doc:
                gone |= {(doc, i + k) for k in range(WINDOW)}
    return gone


@pytest.mark.parametrize("share", [1 << 30, 64_000, 9_000, 600])
def test_suffix_owner_sorts_bounded_shares(monkeypatch, share):
    monkeypatch.setattr(suffix, "SHARE", share, raising=False)
    sorted_bytes, real = [], suffix.two_stage
    monkeypatch.setattr(suffix, "two_stage", lambda data, *a: sorted_bytes.append(len(data)) or real(data, *a))
    texts = _texts()
    keys = [suffix.runs(np.frombuffer(t, np.uint8), np.array([len(t)]), None, WINDOW)[3] >> np.uint64(16) for t in texts.values()]
    right = pa.table({"keys": [np.concatenate(keys).tobytes()]})
    packed, settled = [], []
    for bucket in range(3):
        docs = [d for d in texts if d % 3 == bucket]
        left = pa.table({"doc_id": docs, "tid": docs, "text": [texts[d] for d in docs], "salt": [0] * len(docs)})
        for row in suffix._fragments(WINDOW, 1, False)(left, right).to_pylist():
            if row["block"] is not None:
                (packed if row["block"] >= 0 else settled).append({k: row[k] for k in ("block", "docs", "tids", "starts", "lens", "data")})
    spans = [b for batch in (suffix._mark(WINDOW, False)(iter([pa.RecordBatch.from_pylist(packed)])),) for b in batch]
    if settled:
        spans += suffix._settled(WINDOW)(iter([pa.RecordBatch.from_pylist(settled)]))
    got = {(doc, i) for b in spans for doc, lo, hi in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lo", "hi"))) for i in range(lo, hi)}
    assert got == _brute(texts)
    if share >= 9_000:  # below that, single strings fill a share
        assert max(sorted_bytes) <= share * 51 // 50
    if share < 1 << 30:
        assert len(sorted_bytes) > 2
