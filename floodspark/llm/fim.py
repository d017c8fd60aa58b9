"""Fill-in-middle transformation on piece tables.

A document is never copied while it is rearranged: it is a list of descriptors ``(buffer, start, length)`` over two
immutable buffers, its own bytes and the sentinels.  Cutting splits a descriptor, a form's arrangement permutes the
descriptors and lays sentinels between them, and the inverse permutation restores the text.  Hashes read the
descriptors one after the other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import whole

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: Per form the order in which the parts of a text (0 prefix, 1 middle, 2 suffix) follow, and the sentinel before each.
FORMS: dict[str, tuple[tuple[int, bytes], ...]] = {
    "psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)),
    "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE)),
}
PLAIN = "plain"
TEXT, MARKS = 0, 1

Piece = tuple[int, int, int]


@dataclass(frozen=True)
class Recipe:
    """How documents are cut: ``seed`` deals places and forms by id, the shares are in per cent."""
    seed: int = 1
    transformed: int = 90
    spm: int = 20


class PieceTable:
    """Descriptors over the immutable ``text`` and the sentinels."""

    def __init__(self, text: bytes):
        self.buffers = (text, SENTINELS)
        self.pieces: list[Piece] = [(TEXT, 0, len(text))]

    def cut(self, at: int) -> None:
        """Split the first descriptor that reaches byte ``at``; a cut at an edge leaves an empty one."""
        for k, (buffer, start, length) in enumerate(self.pieces):
            if buffer == TEXT and start <= at <= start + length:
                self.pieces[k:k + 1] = [(buffer, start, at - start), (buffer, at, start + length - at)]
                return
        raise IndexError(at)

    def arrange(self, order: tuple[tuple[int, bytes], ...]) -> None:
        """The descriptors in ``order``, each after its sentinel."""
        out = []
        for place, mark in order:
            out += [(MARKS, SENTINELS.index(mark), len(mark)), self.pieces[place]]
        self.pieces = out

    def restore(self, order: tuple[tuple[int, bytes], ...]) -> None:
        """Undo ``arrange``: without the sentinels, by the inverse permutation."""
        parts = [p for p in self.pieces if p[0] == TEXT]
        back = sorted(range(len(order)), key=lambda k: order[k][0])
        self.pieces = [parts[k] for k in back]

    def stream(self):
        """The bytes of one descriptor after the other, as views."""
        views = [memoryview(b) for b in self.buffers]
        for buffer, start, length in self.pieces:
            yield views[buffer][start:start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.stream())


def parsed(output: bytes, form: str) -> PieceTable:
    """A piece table over an arranged text: its sentinels and the parts between them.

    No part holds a sentinel, and no sentinel's end is the beginning of one, so the first one found is the one laid.
    """
    table = PieceTable(output)
    if form == PLAIN:
        return table
    pieces: list[Piece] = []
    at = 0
    for k, (_, mark) in enumerate(FORMS[form]):
        if output[at:at + len(mark)] != mark:
            raise ValueError(f"not a text of form {form}")
        start = at + len(mark)
        at = output.find(FORMS[form][k + 1][1], start) if k + 1 < len(FORMS[form]) else len(output)
        if at < 0:
            raise ValueError(f"not a text of form {form}")
        pieces += [(MARKS, SENTINELS.index(mark), len(mark)), (TEXT, start, at - start)]
    table.pieces = pieces
    return table


def restored(output: bytes, form: str) -> PieceTable:
    """The table of the text that ``output`` was made of."""
    table = parsed(output, form)
    if form != PLAIN:
        table.restore(FORMS[form])
    return table


def places(key: str, n: int, recipe: Recipe = Recipe()) -> tuple[int, int, str]:
    """Where the document ``key`` of ``n`` code points is cut twice, and its form if it may be transformed."""
    digest = hashlib.sha256(f"{recipe.seed}:{key}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[2] % 100 >= recipe.transformed:
        return low, high, PLAIN
    return low, high, "spm" if h[3] % 100 < recipe.spm else "psm"


def transform_text(key: str, text: str, recipe: Recipe = Recipe()) -> tuple[PieceTable, str, int | None, int | None]:
    """The rearranged table, the form, and the code points of prefix and middle (None if plain)."""
    raw = text.encode()
    table = PieceTable(raw)
    low, high, form = places(key, len(text), recipe)
    if not raw or form == PLAIN or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return table, PLAIN, None, None
    byte = (lambda k: k) if len(raw) == len(text) else (lambda k: len(text[:k].encode()))
    table.cut(byte(low))
    table.cut(byte(high))
    table.arrange(FORMS[form])
    return table, form, low, high - low


def fill_in_middle(docs: DataFrame, recipe: Recipe = Recipe(), doc_id: str = "doc_id", text: str = "text",
                   texts: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, pieces, output, output_sha256, restored_sha256``.

    ``pieces`` are the descriptors (buffer 0 the text, 1 the sentinels; bytes), ``output`` the arranged text, null
    without ``texts``.  ``restored_sha256`` is of the text rebuilt from output and form alone.  A null text is an
    empty one and stays plain, as do texts that hold a sentinel; a row without an id is dealt by the empty key;
    repeated rows get equal results; an empty table gives an empty result.
    """
    def run(keys: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        out = []
        for key, body in zip(keys, bodies):
            table, form, prefix, middle = transform_text(key, body, recipe)
            content = table.content()
            pieces = [{"buffer": b, "start": s, "length": n} for b, s, n in table.pieces]
            out.append((len(body), form, prefix, middle, pieces, content.decode() if texts else None,
                        table.sha256(), restored(content, form).sha256()))
        frame = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "pieces", "output",
                                           "output_sha256", "restored_sha256"])
        return frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    done = F.pandas_udf(run, "n long, form string, prefix_chars long, middle_chars long, "
                             "pieces array<struct<buffer: int, start: long, length: long>>, output string, "
                             "output_sha256 string, restored_sha256 string")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), done(key, whole(text)).alias("_f")).select("doc_id", "_f.*")


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` with a column ``restored``: the text that ``output`` was made of (null where either is null)."""
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restored(o.encode(), f).content().decode()
                          for o, f in zip(outputs, forms)], dtype=object)

    return rows.withColumn("restored", F.pandas_udf(run, "string")(F.col(output), F.col(form)))
