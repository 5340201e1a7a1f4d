"""Personal data by weak supervision; DataFrame functions only.

Base kinds (email, ip, card, phone) come from fixed expressions. Further candidates - identifier-like tokens with a digit,
and behind a term of the gazetteer or an assignment also tokens of 6 to 11 characters and groups set apart by spaces - get
votes from regex, gazetteer and context labelers (1 private, 0 not, - abstains). Expectation-maximisation over the
table of vote patterns (at most 3**LABELERS rows) estimates how reliable each labeler is; its posteriors train a
logistic classifier over votes and shape features, counted by pattern as well, and spans that it scores at or above
THRESHOLD are added as kind `secret`. Candidates that overlap a base span are left to it.

Defined results: null text counts as empty (no spans, hash of the empty string); null doc_id passes through;
repeated rows get equal results; no rows give no rows; whole texts are read; further columns are ignored.
U+E000..U+E002 in a text are matched as U+FFFD, which no expression contains, so offsets hold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table
from .op2_quality import let

OPEN, SHUT, JOIN = "\ue000", "\ue001", "\ue002"
KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = 6
THRESHOLD = 0.5
CONTEXT = 24
SPAN = "struct<s:bigint,e:bigint,m:string,pre:string,post:string>"


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array of (s, e, m, pre, post), code points, end exclusive."""

    def cut(parts: Column) -> Column:
        starts = F.aggregate(
            parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
            lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["all"], a["at"]).alias("all")), lambda a: a["all"],
        )

        def spans(st: Column) -> Column:
            odd = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
            return F.transform(
                odd,
                lambda i: F.struct(
                    F.get(st, i).alias("s"), (F.get(st, i) + F.length(F.get(parts, i))).alias("e"), F.get(parts, i).alias("m"),
                    F.right(F.get(parts, i - 1), F.lit(CONTEXT)).alias("pre"), F.left(F.coalesce(F.get(parts, i + 1), F.lit("")), F.lit(2)).alias("post"),
                ),
            )

        return F.when(F.size(parts) > 1, let(starts, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(F.split(F.regexp_replace(text, pattern, OPEN + "$0" + SHUT), f"[{OPEN}{SHUT}]"), cut)


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _luhn(m: Column) -> Column:
    digits = F.reverse(F.regexp_replace(m, "[^0-9]", ""))

    def total(d: Column) -> Column:
        def value(i: Column) -> Column:
            v = F.substr(d, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

        return F.when(F.length(d).between(12, 19), F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), value), F.lit(0), lambda a, v: a + v) % 10 == 0).otherwise(F.lit(False))

    return let(digits, total)


def _octets(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, F.coalesce(F.when(p == "", 0).otherwise(p.cast("int")), F.lit(0)) <= 255).otherwise(F.lit(False)))


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind. Separators between two admissible characters are marked first, so that every expression is a plain
    run of one character class (the regex engine never recurses, and never rescans a run)."""
    dotted = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOIN)
    spaced = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", JOIN)
    local = f"[A-Za-z0-9._%+{JOIN}-]"
    email = rf"(?:\G|(?<!{local})){local}++@[A-Za-z0-9-]++{JOIN}[A-Za-z0-9{JOIN}-]++"
    digit = text.rlike("[0-9]")
    return {
        "email": F.when(F.instr(text, "@") > 0, find(dotted, email)).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(find(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), lambda x: _octets(x["m"]))).otherwise(_none()),
        "card": F.when(digit, F.filter(find(spaced, rf"[0-9][0-9{JOIN}]*+(?<=[0-9]{{2}}|{JOIN}[0-9])"), lambda x: _luhn(x["m"]))).otherwise(_none()),
        "phone": F.when(F.instr(text, "+") > 0, F.filter(find(text, r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: _digits(x["m"]).between(9, 15))).otherwise(_none()),
    }


#: Gazetteer of terms that announce a credential or an identifier.
TERMS = r"\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer|ssn|iban|passport|account|mot de passe|passwort|contraseña)\b"
GAZETTEER = "(?i)" + TERMS
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{12,}+(?![A-Za-z0-9_-])"
#: Short tokens, IBANs in groups and digits in groups, where such a term or an assignment stands close before.
ANNOUNCED = (
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?:(?<=[=:][\x20\x09]{0,4}[\"']?)|(?<=(?i:" + TERMS + r")[^\n]{1,12}))"
    r"(?:[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9_-]))?|[0-9]{2,4}(?:\x20[0-9]{2,4}){2,8}+|[A-Za-z0-9_-]{6,11}+)(?![A-Za-z0-9_-])"
)


def votes(x: Column) -> Column:
    """One character a labeler: regex (hex, long mixed, few digits), gazetteer before, assignment before, quotes around."""
    n, digits = F.length(x["m"]), _digits(x["m"])
    return F.concat(
        F.when(x["m"].rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$") & x["m"].rlike("[A-Fa-f]"), "1").otherwise("-"),
        F.when((n >= 20) & (digits >= 4) & x["m"].rlike("[A-Za-z]"), "1").when(digits < 3, "0").otherwise("-"),
        F.when(x["m"].rlike("^[A-Za-z]+[_-]?[0-9]{1,4}$") | x["m"].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "0").otherwise("-"),
        F.when(x["pre"].rlike(GAZETTEER), "1").otherwise("0"),
        F.when(x["pre"].rlike(r"[=:][\x20\x09]*[\"']?$"), "1").when(x["pre"].rlike(r"[/.#?&-]$"), "0").otherwise("-"),
        F.when(x["pre"].rlike("[\"'`]$") & x["post"].rlike("^[\"'`]"), "1").otherwise("-"),
    )


def shape(x: Column) -> Column:
    """Length and digit-share buckets, one character each."""
    n = F.length(x["m"])
    return F.concat(F.when(n < 16, "a").when(n < 24, "b").when(n < 48, "c").otherwise("d"), F.floor(_digits(x["m"]) * 3 / n).cast("string"))


def estimate(patterns: dict[str, int], rounds: int = 50) -> tuple[np.ndarray, float]:
    """EM over vote patterns: P(vote | class) as [labeler, vote, class] and the share of private candidates."""
    keys, n = list(patterns), np.array(list(patterns.values()), float)
    seen = np.array([["01-".index(c) for c in k] for k in keys], int).reshape(-1, LABELERS)
    post = np.clip(0.5 + 0.25 * ((seen == 1).sum(1) - (seen == 0).sum(1)), 0.05, 0.95)
    theta, prior = np.full((LABELERS, 3, 2), 1 / 3), 0.5
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post], 1)
        prior = float(np.clip((weight[:, 1].sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        for j in range(LABELERS):
            for v in range(3):
                theta[j, v] = weight[seen[:, j] == v].sum(0) + np.array([[3, 1], [1, 3], [2, 2]])[v]
            theta[j] /= theta[j].sum(0)
        log = np.log([1 - prior, prior]) + sum(np.log(theta[j][seen[:, j]]) for j in range(LABELERS))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return theta, prior


def _columns(pattern: str) -> list[str]:
    votes_, shape_ = pattern[:LABELERS], pattern[LABELERS:]
    return [f"v{j}{c}" for j, c in enumerate(votes_)] + [f"n{shape_[0]}", f"d{shape_[1]}"]


def train(patterns: dict[str, int], rounds: int = 300, ridge: float = 1.0) -> dict[str, float]:
    """Logistic regression on (votes, shape) patterns with EM posteriors as soft labels; weights by feature name."""
    by_votes: dict[str, int] = {}
    for k, n in patterns.items():
        by_votes[k[:LABELERS]] = by_votes.get(k[:LABELERS], 0) + n
    if not patterns:
        return {"bias": 0.0}
    theta, prior = estimate(by_votes)
    names = ["bias", *sorted({c for k in patterns for c in _columns(k)})]
    x = np.array([[1.0] + [float(c in _columns(k)) for c in names[1:]] for k in patterns])
    n = np.array(list(patterns.values()), float)
    seen = np.array([["01-".index(c) for c in k[:LABELERS]] for k in patterns])
    log = np.log([1 - prior, prior]) + sum(np.log(theta[j][seen[:, j]]) for j in range(LABELERS))
    soft = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    w = np.zeros(len(names))
    for _ in range(rounds):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (n * (p - soft)) + ridge * w
        hess = (x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(names, w.round(9).tolist()))


def _score(pattern: Column, weights: dict[str, float]) -> Column:
    """The classifier as a sum of small CASEs over the pattern's characters."""
    total = F.lit(weights["bias"])
    for at in range(LABELERS + 2):
        letter, terms = F.substring(pattern, at + 1, 1), {}
        for name, w in weights.items():
            if name == "bias":
                continue
            if (at < LABELERS and name[:-1] == f"v{at}") or (at == LABELERS and name[0] == "n") or (at == LABELERS + 1 and name[0] == "d"):
                terms[name[-1]] = w
        if terms:
            case = None
            for c, w in terms.items():
                case = F.when(letter == c, w) if case is None else case.when(letter == c, w)
            total = total + case.otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def find_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, base and all (arrays of kind, s, e), in order of start and kind."""
    text = F.coalesce("text", F.lit(""))
    clean = F.when(text.rlike(f"[{OPEN}-{JOIN}]"), F.translate(text, OPEN + SHUT + JOIN, "\ufffd" * 3)).otherwise(text)
    clean_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean.alias("t"))

    def tag(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))

    def labelled(t: Column) -> Column:
        by_kind = base_spans(t)
        tagged = F.concat(*(tag(by_kind[k], i) for i, k in enumerate(KINDS[:4])))
        found = F.when(t.rlike("[0-9]"), find(t, CANDIDATE)).otherwise(_none())
        announced = F.when(t.rlike(f"[=:]|{GAZETTEER}") & t.rlike("[0-9]"), find(t, ANNOUNCED)).otherwise(_none())
        # a second pass, so that the tokens of the first keep the text before them
        both = let(found, lambda f: F.concat(f, F.filter(announced, lambda c: ~F.exists(f, lambda x: (x["s"] < c["e"]) & (c["s"] < x["e"])))))
        more = F.transform(both, lambda x: F.struct(x["s"].alias("s"), F.lit(4).alias("k"), x["e"].alias("e"), F.concat(votes(x), shape(x)).alias("p")))
        return F.struct(F.array_sort(tagged).alias("base"), more.alias("more"))

    rows = stash(clean_docs.select("doc_id", let(F.col("t"), labelled).alias("f")), "pii")
    free = F.filter("f.more", lambda c: ~F.exists("f.base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    patterns = rows.filter(F.size("f.more") > 0).select(F.explode(free).alias("c")).groupBy("c.p").count().collect()  # at most 3**LABELERS * 16 rows
    weights = train({r.p: r["count"] for r in patterns})
    added = F.transform(F.filter(free, lambda c: _score(c["p"], weights) >= THRESHOLD), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    return rows.select("doc_id", F.col("f.base").alias("base"), F.when(F.size("f.more") > 0, F.array_sort(F.concat("f.base", added))).otherwise(F.col("f.base")).alias("all"))


def _text(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))
