"""Plain re-statements of the contracts, row by row, for small fixtures."""

import hashlib
import re

import numpy as np

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def pii(text):
    spans = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS.items()) for m in p.finditer(text or "") if passes(k, m.group()))
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    return {f"n_{k}": sum(x[3] == k for x in spans) for k in KINDS} | {"base_sha256": hashlib.sha256(joined.encode()).hexdigest()}


def suffix(docs, window=50):
    """docs: list of (doc_id, text)."""
    first = {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            first.setdefault(data[i : i + window], doc)
    out = {}
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if first[data[i : i + window]] < doc:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def least_squares_rates(p, tokens, target, ridge, most, rounds=20000):
    """Rates that minimise the mixing objective, by coordinate-free descent on all documents with small steps."""
    w = tokens / tokens.sum()
    metric = np.linalg.inv((p.T * w) @ p)
    want = target / tokens.sum()
    r = np.ones(len(p))
    for _ in range(rounds):
        r = np.clip(r - 0.5 * (p @ (metric @ ((w * r) @ p - want)) + ridge * (r - 1)), 0, most)
    gap = (w * r) @ p - want
    return r, gap @ metric @ gap / 2 + ridge * (w * (r - 1) ** 2).sum() / 2


def open_text(pages, window, share):
    """pages (page_id, url, <p> blocks only): the words that no boilerplate of their host covers, by counting every window."""
    hosts = {}
    for number, url, html in pages:
        hosts.setdefault(url.split("/")[2], {})[number] = "\n".join(re.findall("<p>(.*?)</p>", html)).encode()
    out = {}
    for texts in hosts.values():
        different = set(texts.values())
        count = {}
        for t in different:
            for w in {t[i : i + window] for i in range(len(t) - window + 1)}:
                count[w] = count.get(w, 0) + 1
        for number, t in texts.items():
            gone = bytearray(len(t))
            for i in range(len(t) - window + 1):
                if count[t[i : i + window]] >= max(2, share * len(different)):
                    gone[i : i + window] = b"\1" * window
            out[number] = " ".join(m.group().decode() for m in re.finditer(rb"[^ \n]+", t) if not all(gone[m.start() : m.end()]))
    return out


def sentence_runs(text, span):
    """(first word, end word) of every run of span sentences; sentences end at line ends and behind words with a closing mark."""
    ends, n = [], 0
    for line in text.split("\n"):
        words = line.split()
        for i, w in enumerate(words):
            n += 1
            if i == len(words) - 1 or re.search("[.!?…。！？][\"')\\]]*$", w):
                ends.append(n)
    return [(a, b) for a, b in zip([0, *ends], ends[span - 1 :])]
