"""Dialects of all documents, those with quotes among them, against a lexer that goes character by character."""

from collections import Counter

import pytest

from lithograin import catalog
from lithograin.sources import delimited

NAMES = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe"}
TEXTS = [
    'a,b\n"x,1",2\n"say ""hi""",3\n', 'a;b\n"x;1";2\n\n"y\nz";3', '"no separators"', 'plain,text\n1,2\n', 'he said "no, never", and left; then\nnothing',
    '"unterminated,1\n2,3', '"a"tail,b|c\n"d",e|f\n', '"a",b|c\n', 'a,"b";c,"d"', '"x"\t1\r\n"y"\t2\r\n', '', None, 'a,b\rc,"d"', 'x|"y"\nz', '"a;b"\n"c"',
]


def lex(text, d):
    """Records as lists of (width unit, quoted); None where the text is malformed."""
    records, fields, quoted, inside, fresh, i = [], [], False, False, True, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                inside = False
        elif c == '"' and fresh:
            quoted = inside = True
            fresh = False
        elif c == d:
            fields.append(quoted)
            quoted, fresh = False, True
        elif c in "\r\n":
            if c == "\r" and text[i + 1 : i + 2] != "\n":
                return None
            i += c == "\r"
            records.append((fields + [quoted], not fields and fresh))
            fields, quoted, fresh = [], False, True
        else:
            fresh = False
        i += 1
    if inside:
        return None
    if fields or not fresh:
        records.append((fields + [quoted], False))
    return records


def score(text, d):
    records = lex(text, d)
    widths = Counter(len(f) for f, blank in records or () if not blank)
    separators = sum(len(f) - 1 for f, _ in records or ())
    if not widths or not separators:
        return None
    modal, width = max((n, w) for w, n in widths.items())
    return len(widths) == 1, sum(sum(f) for f, _ in records), modal, separators, width


def test_all_documents(spark, tmp_path):
    extra = spark.createDataFrame([(-i, t) for i, t in enumerate(TEXTS, 1)], "doc_id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("cast(doc_id as long) doc_id", "text").union(extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text]
    assert sum('"' in t for _, t in rows) > 20
    want = {(doc, NAMES[d]): s for doc, t in rows for d in NAMES if '"' in t or "\r" not in t if (s := score(t, d))}
    got = catalog.QUERIES["dialect_scores_all"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.delimiter): (r.consistent, r.quoted_fields, r.modal_records, r.separators, r.modal_width) for r in got} == want and len(got) == len(want)

    best = {}
    for (doc, d), s in want.items():
        best.setdefault(doc, []).append((s, d))
    outcome = {doc: ("detected", max(all_)[1]) if [s for s, _ in all_].count(max(all_)[0]) == 1 else ("ambiguous", None) for doc, all_ in best.items()}
    text = dict(rows)
    found = {r.doc_id: (r.outcome, r.delimiter) for r in catalog.QUERIES["dialect_detected_all"](spark, str(tmp_path)).collect()}
    whole = {doc for doc in text if all(lex(text[doc], d) is not None for d in NAMES)}
    assert {doc: o for doc, o in found.items() if doc in whole} == {doc: o for doc, o in outcome.items() if doc in whole}
    assert {doc for doc in text if '"' in text[doc]} & set(outcome) <= set(found) and found[-6] == ("malformed", None)


def test_framer_cuts_as_the_scan_does():
    """Records of random texts, fed in pieces of random sizes, down to single bytes."""
    import random

    own = random.Random(4)
    good = broken = 0
    for turn in range(3000):
        data = "".join(own.choice(['"', '"', ",", ";", "\n", "\r\n", "\r" if turn % 7 == 0 else "x", "a", "bc", '""', "é"]) for _ in range(own.randint(0, 14))).encode()
        cuts = sorted(own.randint(0, len(data)) for _ in range(own.randint(0, 5)))
        pieces = [data[i : i + 1] for i in range(len(data))] if turn % 3 == 0 else [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        try:
            want = [b",".join(fields) + newline for fields, newline in delimited.scan(data)]
        except delimited.Malformed as e:
            with pytest.raises(delimited.Malformed, match=str(e)):
                list(delimited.frame(iter(pieces)))
            broken += 1
            continue
        assert list(delimited.frame(iter(pieces))) == want, (data, pieces)
        good += 1
    assert good > 500 and broken > 500
    with pytest.raises(delimited.Malformed, match="too long"):
        list(delimited.frame(iter([b"a" * 10] * 3), max_record=20))
