"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, digits, URL schemes and
identifier cues; from each anchor a small deterministic parser walks out to the
boundaries of an email, address, number or account and validates it.

Defined results: null text counts as empty; repeated rows each get their row.
Places are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib

import ahocorasick
from pyspark.sql import DataFrame

from skylattice.llm.arrow import map_batches

KINDS = ("email", "ip", "card", "phone", "url", "account")
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL, LABEL = ALNUM | set("._%+-"), ALNUM | {"-"}
PHONE = DIGITS | set(" ().-")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "iban", "passport", "ssn")
URL_END = frozenset(" \t\r\n\"'<>|)]}")
SEPARATORS = frozenset(" :#=.-")


def run(text: str, at: int, allowed: frozenset | set) -> int:
    """End of the run of allowed characters that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email(text: str, at: int, low: int) -> tuple[int, int] | None:
    """Expand an at-sign; nothing before ``low`` (the end of the last email) may be used."""
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    end = run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while text[end : end + 1] == "." and (more := run(text, end + 1, LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def ip(text: str, at: int) -> tuple[int, bool] | None:
    """End of four dotted numbers, and whether all are at most 255."""
    end, good = at, True
    for part in range(4):
        if part:
            if text[end : end + 1] != ".":
                return None
            end += 1
        stop = run(text, end, DIGITS)
        if stop == end:
            return None
        number = text[end:stop].lstrip("0") or "0"
        good &= len(number) <= 3 and int(number) <= 255
        end = stop
    return end, good


def card(text: str, at: int) -> tuple[int, bool] | None:
    """End of digits with single spaces or hyphens between, and whether 13-19 of them pass the Luhn sum."""
    end, digits = run(text, at, DIGITS), []
    while text[end : end + 1] in (" ", "-") and text[end + 1 : end + 2] in DIGITS:
        end = run(text, end + 1, DIGITS)
    if end == at + 1:
        return None
    if end - at <= 40:
        digits = [int(c) for c in text[at:end] if c in DIGITS]
    if not 13 <= len(digits) <= 19:
        return end, False
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return end, total % 10 == 0


def phone(text: str, at: int) -> tuple[int, bool] | None:
    """End of an international number from its plus sign, and whether it has 9-15 digits."""
    if text[at + 1 : at + 2] not in DIGITS or at + 1 >= len(text):
        return None
    end = run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGITS:
        return None
    return end, 9 <= sum(c in DIGITS for c in text[at:end]) <= 15


def url_run(text: str, at: int) -> tuple[int, int, int]:
    """Of the run of URL characters from ``at``: its end, its end without closing punctuation, the last @ or ? (or -1)."""
    stop = at
    while stop < len(text) and text[stop] not in URL_END:
        stop += 1
    end = stop
    while end > at and text[end - 1] in ".,;:!":
        end -= 1
    return stop, end, max(text.rfind("@", at, end), text.rfind("?", at, end))


def account(text: str, cue_end: int) -> tuple[int, int] | None:
    """The identifier after a cue: up to three separators or short words, then 6-34 capitals and digits with 3 digits at least."""
    at = cue_end
    for _ in range(3):
        at = run(text, at, SEPARATORS)
        for word in ("number", "no", "id"):
            if text[at : at + len(word)].lower() == word:
                at += len(word)
                break
        else:
            break
    end = at
    while end < len(text) and end - at <= 34 and text[end] in ALNUM:
        end += 1
    token = text[at:end]
    if at > cue_end and 6 <= len(token) <= 34 and token == token.upper() and sum(c in DIGITS for c in token) >= 3:
        return at, end
    return None


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c, 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every span, by kind and then start."""
    out: list[tuple[int, int, int]] = []
    low = [0] * len(KINDS)
    stop, url_end, mark = 0, 0, -1  # of the run of URL characters met last: nested schemes share it
    for last, (what, size) in anchors.iter(text):
        at = last - size + 1
        if what == "@":
            if at >= low[0] and (hit := email(text, at, low[0])):
                low[0] = hit[1]
                out.append((0, *hit))
        elif what == "+":
            if at >= low[3] and (hit := phone(text, at)):
                low[3] = hit[0]
                if hit[1]:
                    out.append((3, at, hit[0]))
        elif what == "scheme":
            if at >= stop:
                stop, url_end, mark = url_run(text, at)
            if at >= low[4] and mark >= at + size:  # a URL with a user part or a query
                low[4] = url_end
                out.append((4, at, url_end))
        elif what == "cue":
            if at >= low[5] and (hit := account(text, at + size)):
                low[5] = hit[1]
                out.append((5, *hit))
        elif at == 0 or text[at - 1] not in DIGITS:
            if at >= low[1] and (hit := ip(text, at)):
                low[1] = hit[0]
                if hit[1]:
                    out.append((1, at, hit[0]))
            if at >= low[2] and (hit := card(text, at)):
                low[2] = hit[0]
                if hit[1]:
                    out.append((2, at, hit[0]))
    return sorted(out)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, the digest of their spans and all spans, per row of docs."""

    def make():
        anchors = automaton()

        def fn(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": cols["doc_id"], "n_email": [], "n_ip": [], "n_card": [], "n_phone": [], "base_sha256": [], "spans": []}
            for text in cols["text"]:
                spans = find(text or "", anchors)
                names = [f"{KINDS[k]}:{s}:{e}" for k, s, e in spans]
                base = ",".join(x for x, (k, _, _) in zip(names, spans, strict=True) if k < 4)
                for k in range(4):
                    out["n_" + KINDS[k]].append(sum(s[0] == k for s in spans))
                out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                out["spans"].append(",".join(names))
            return out

        return fn

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
