"""Fill-in-middle transformation over ropes.

A text becomes a rope: a balanced tree whose leaves hold pieces of it and whose
nodes cache the units (lines) and code points below them.  Two unit ranks split
the tree in three; the subtrees are joined in another order with sentinels
between them.  The way back splits the tree of the output at the sentinels and
joins the parts as they were.  Pieces are not copied but for the two leaves on
a split.

The cuts depend on a hash of a seed and the id alone, so any run on any
machine gives the same output.

Defined results: null counts as empty; an empty text, one that holds a
sentinel and one that the rate leaves out stay as they are (form plain, null
sizes); repeated rows each get their row and equal output; a null id is hashed
as an empty string; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from skylattice.llm.arrow import map_batches

#: Code points of a leaf.
LEAF = 4096
#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Order of the parts (prefix 0, suffix 1, middle 2) and of the sentinels before them, by form.
ORDERS = {"psm": ((0, 1, 2), (0, 1, 2)), "spm": ((1, 0, 2), (1, 0, 2))}


class Rope:
    """A leaf (text) or a node (left, right) with its newlines and code points."""

    __slots__ = ("text", "left", "right", "newlines", "chars")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.newlines, self.chars = text.count("\n"), len(text)
        else:
            self.newlines, self.chars = left.newlines + right.newlines, left.chars + right.chars

    @staticmethod
    def of(text: str) -> Rope:
        """A balanced tree of the leaves of a text."""
        row = [Rope(text[i : i + LEAF]) for i in range(0, len(text), LEAF)] or [Rope("")]
        while len(row) > 1:
            row = [Rope(left=row[i], right=row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return row[0]

    def __add__(self, other: Rope) -> Rope:
        if not self.chars or not other.chars:
            return self if self.chars else other
        return Rope(left=self, right=other)

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            x = todo.pop()
            if x.text is not None:
                yield x.text
            else:
                todo += (x.right, x.left)

    def __str__(self) -> str:
        return "".join(self.leaves())

    def ends_open(self) -> bool:
        """The last unit has no newline at its end."""
        x = self
        while x.text is None:
            x = x.right
        return bool(x.text) and not x.text.endswith("\n")

    def units(self) -> int:
        return self.newlines + self.ends_open()

    def split_chars(self, k: int) -> tuple[Rope, Rope]:
        """The first k code points, and the rest."""
        if self.text is not None:
            return Rope(self.text[:k]), Rope(self.text[k:])
        if k <= self.left.chars:
            a, b = self.left.split_chars(k)
            return a, b + self.right
        a, b = self.right.split_chars(k - self.left.chars)
        return self.left + a, b

    def split_units(self, k: int) -> tuple[Rope, Rope]:
        """The first k units, and the rest."""
        if k <= 0:
            return Rope(""), self
        if k > self.newlines:  # all, with a last unit that has no newline
            return self, Rope("")
        if self.text is not None:
            at = 0
            for _ in range(k):
                at = self.text.index("\n", at) + 1
            return Rope(self.text[:at]), Rope(self.text[at:])
        if k <= self.left.newlines:
            a, b = self.left.split_units(k)
            return a, b + self.right
        a, b = self.right.split_units(k - self.left.newlines)
        return self.left + a, b


def plan(doc_id, units: int, seed: int, rate: int, spm_rate: int) -> tuple[int, int, str]:
    """Ranks of the two cuts and the form, from the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (units + 1), h[1] % (units + 1)))
    return a, b, "plain" if h[2] % 100 >= rate else "spm" if h[3] % 100 < spm_rate else "psm"


def rearranged(doc_id, text: str, seed: int, rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of a text."""
    rope = Rope.of(text)
    n = rope.units()
    a, b, form = plan(doc_id, n, seed, rate, spm_rate)
    if not text or form == "plain" or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    prefix, rest = rope.split_units(a)
    middle, suffix = rest.split_units(b - a)
    parts, (order, marks) = (prefix, suffix, middle), ORDERS[form]
    out = Rope("")
    for p, m in zip(order, marks, strict=True):
        out = out + Rope(sentinels[m]) + parts[p]
    return n, form, prefix.chars, middle.chars, str(out)


def rebuilt(output: str, form: str, sentinels: tuple[str, str, str]) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    order, marks = ORDERS[form]
    rope, parts, gone = Rope.of(output), {}, 0
    starts = [output.index(sentinels[m]) for m in marks]
    for p, m, end in zip(order, marks, [*starts[1:], len(output)], strict=True):
        piece, rope = rope.split_chars(end - gone)
        parts[p] = piece.split_chars(len(sentinels[m]))[1]
        gone = end
    return str(parts[0] + parts[2] + parts[1])


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output of every row of docs.

    ``rate`` hundredths of the texts are rearranged, ``spm_rate`` hundredths
    of these with the suffix first.
    """

    def make():
        def fn(c: dict[str, list]) -> dict[str, list]:
            rows = [rearranged(i, t or "", seed, rate, spm_rate, sentinels) for i, t in zip(c["doc_id"], c["text"], strict=True)]
            return {"doc_id": c["doc_id"], **{k: [r[j] for r in rows] for j, k in enumerate(("n", "form", "prefix_chars", "middle_chars", "output"))}}

        return fn

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of ``transform`` with the restored text."""

    def make():
        return lambda c: {**c, "restored": [rebuilt(o, f, sentinels) for o, f in zip(c["output"], c["form"], strict=True)]}

    d = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return map_batches(d, make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
r AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2, ('0x' || h[25:32])::BIGINT % 100 AS h4, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
p AS (SELECT *, array_to_string(u[1:least(c1, c2)], '') AS a, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:n], '') AS s FROM r),
f AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(a) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
