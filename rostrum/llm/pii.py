"""Personal data by weak supervision.

Strict patterns find the base spans; wider patterns propose more. Five labelers (pattern,
gazetteer, context words, edges, grouping) vote on every candidate. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is per
kind, and a logistic regression on votes and shape, trained on its posteriors, decides
which proposals become spans. Spark counts the patterns over all documents; only that
table, bounded by the number of patterns, reaches the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import add_columns, as_text, map_batches, register, table

KINDS = ("email", "ip", "card", "phone")
VOTES = 5
SHAPES = 4
DIGIT = re.compile("[0-9]")
AT = re.compile(r"\bat\b|[\[({] ?(?:at|@)")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match always ends where its run of digits ends, so possessive runs that start after no digit find the same matches.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}+ ?(?:[\[({] ?(?:at|@) ?[\])}]|\bat\b) ?[A-Za-z0-9-]{1,63}+"
                        r"(?: ?(?:\.|[\[({] ?(?:dot|\.) ?[\])}]|\bdot\b) ?[A-Za-z0-9-]{2,63}+){1,6}"),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![\w+.-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]{1,2}[0-9]{2,4}){2,4}(?![\w-])"),
}
# Words whose presence before a span speaks for a kind, and words that speak against any.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "ping"),
    "card": ("card", "visa", "mastercard", "amex", "payment", "credit", "debit"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "whatsapp", "contact"),
}
AGAINST = ("version", "isbn", "issn", "doi", "order", "ref", "id", "section", "page", "total", "date", "token", "password")
# Endings of domains, calling codes, first digits of card numbers.
DOMAIN_ENDS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl pl se ch at be eu us ca au jp cn in br ru".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "30", "36", "38")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [2 * int(c) for c in digits[-2::-2]]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def ip_parts_fit(s: str) -> bool:
    return all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards, in time linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Checked matches of the strict patterns, by kind."""
    if not DIGIT.search(text):
        return [emails(text), [], [], []]
    ips = [m.span() for m in IP.finditer(text) if ip_parts_fit(m[0])]
    cards = [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return [emails(text), ips, cards, phones]


def proposals(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """Matches of the wide patterns that touch no base span."""
    taken = sorted(x for spans in base for x in spans)
    has_digit = bool(DIGIT.search(text))
    out = []
    for k, kind in enumerate(KINDS):
        # Every match holds what is asked for here; an address of words between colons may hold no digit.
        if not (AT.search(text) if kind == "email" else has_digit or kind == "ip" and text.count(":") >= 4):
            continue
        for m in WIDE[kind].finditer(text):
            a, b = m.span()
            if kind == "phone" and not 9 <= len(digits_of(m[0])) <= 15:
                continue
            if not any(x < b and a < y for x, y in taken):
                out.append((k, a, b))
                taken.append((a, b))
    return out


def votes(text: str, k: int, a: int, b: int, strict: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstains: pattern, gazetteer, context, edges, grouping."""
    kind, s = KINDS[k], text[a:b]
    digits = digits_of(s)
    if kind == "email":
        listed = 1 if re.split(r"[^a-z0-9-]+", s.lower().rstrip(")]} "))[-1] in DOMAIN_ENDS else -1
        grouped = -1 if ". " in s else 0  # more likely the end of a sentence
    elif kind == "ip":
        listed = -1 if digits[:1] == "0" else 1 if ":" in s or digits else 0
        grouped = 0
    elif kind == "card":
        listed = 1 if digits.startswith(ISSUERS) else -1
        grouped = 1 if re.fullmatch(r"[0-9]+|[0-9]{4}([ -][0-9]{4}){3}", s) and luhn(digits) else -1
    else:
        listed = 1 if s[:1] == "+" and digits.startswith(CALLING) or s.startswith("00") else 0
        grouped = 1 if len(re.findall("[0-9]+", s)) >= 3 else -1
    before = re.findall(r"[a-z-]+", text[max(0, a - 40):a].lower())[-4:]
    context = 1 if any(w in CONTEXT[kind] for w in before) else -1 if any(w in AGAINST for w in before) else 0
    edge = lambda c: not c or not (c.isalnum() or c in "_/=")
    edges = 1 if edge(text[a - 1:a] if a else "") and edge(text[b:b + 1]) else -1
    return 1 if strict else -1, listed, context, edges, grouped


def shape(text: str, a: int, b: int) -> tuple[int, ...]:
    s = text[a:b]
    return int(len(s) >= 16), int(" " in s), int(any(c.isalpha() for c in s)), int(s[:1] == "+")


def candidates(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int, str]]]:
    """Base spans by kind, and every candidate as kind, start, end and its pattern of votes and shape."""
    base = base_spans(text)
    every = [(k, a, b, True) for k, spans in enumerate(base) for a, b in spans]
    every += [(k, a, b, False) for k, a, b in proposals(text, base)]
    return base, [(k, a, b, f"{k}|" + ",".join(map(str, votes(text, k, a, b, s) + shape(text, a, b)))) for k, a, b, s in every]


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Probability of being personal data for every pattern of kind, votes and shape that occurs in the texts."""

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for t in as_text(b.column(0)):
                held.update(p for *_, p in candidates(t)[1])
        yield list(held), list(held.values())

    rows = map_batches(docs.select(text_col), count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = dict(rows.collect())  # at most 4 kinds * 3^5 votes * 2^4 shapes
    return classify(counts)


def posteriors(v: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Chance that a vote pattern marks personal data: Dawid-Skene with abstention, by expectation maximisation."""
    one_hot = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)
    p = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))
    for _ in range(rounds):
        say = []
        for weight in (p * n, (1 - p) * n):
            told = np.einsum("i,ijx->jx", weight, one_hot) + 1.0
            say.append(told / told.sum(axis=1, keepdims=True))
        prior = ((p * n).sum() + 1) / (n.sum() + 2)
        log_odds = np.log(prior / (1 - prior)) + np.einsum("ijx,jx->i", one_hot, np.log(say[0] / say[1]))
        p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return p


def classify(counts: dict[str, int]) -> dict[str, float]:
    """A logistic regression per kind on votes and shape, trained on the posteriors; no patterns give an empty model."""
    out: dict[str, float] = {}
    for k in sorted({p.split("|")[0] for p in counts}):
        patterns = sorted(p for p in counts if p.startswith(f"{k}|"))
        x = np.array([[int(i) for i in p.split("|")[1].split(",")] for p in patterns], dtype=float)
        n = np.array([counts[p] for p in patterns], dtype=float)
        target = posteriors(x[:, :VOTES], n)
        x = np.column_stack([x, np.ones(len(x))])
        share, w = n / n.sum(), np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps with a small ridge
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (share * (q - target)) + 1e-3 * w
            bend = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w -= np.linalg.solve(bend, slope)
        out |= dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))
    return out


def accepted(pattern: str, model: dict[str, float], least: float) -> bool:
    return model.get(pattern, 0.0) >= least


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span, or union of overlapping spans, becomes the name of its first kind in brackets."""
    out, last = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= last:
            out += (text[last:a], f"[{KINDS[k].upper()}]")
        last = max(last, b)
    return "".join(out) + text[last:]


def find_pii(docs: DataFrame, model: dict[str, float], text_col: str = "text", keep: list[str] | None = None,
             least: float = 0.5, with_masked: bool = False) -> DataFrame:
    """Append ``n_email, n_ip, n_card, n_phone, base_sha256, spans`` and, if asked for, ``masked``.

    Offsets are code points. Null texts count as empty (``masked`` stays null); each row is
    judged alone; columns with the names of results are replaced.
    """

    def run(text):
        rows = []
        for t in text.to_pylist():
            base, every = candidates(t or "")
            first = [(k, a, b) for k, spans in enumerate(base) for a, b in spans]
            own = first + [(k, a, b) for k, a, b, p in every[len(first):] if accepted(p, model, least)]
            row = [len(s) for s in base] + [hashlib.sha256(told(first).encode()).hexdigest(), told(own)]
            rows.append(row + [t if t is None else masked(t, own)] * with_masked)
        return list(zip(*rows)) or [[]] * (6 + with_masked)

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", masked string" * with_masked
    return add_columns(docs, [text_col], run, schema, keep=keep)


@register("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit(docs), keep=["doc_id"])
