"""SentencePiece BPE by a merge-type prefix table, and back.

Byte-pair merges have two properties that spare the merge queue: every prefix of a text has one last
token, and a sequence of tokens is what the merges give exactly if each pair of neighbours is. So the
table stores, for each prefix, its unique last token: an automaton over the pieces lists those that
end there, and a piece fits if it is compatible with the last token of the prefix before it. Ids are
then recovered backwards from the whole text's last token. That is linear in the text.

Two tokens are compatible if no merge would have crossed their border. Both were merged from
characters; the merges at the border (the spines) are replayed in order of score and place, and a
crossing piece that would have come first rules the pair out.

No piece goes on with a blank after another character, and some characters are in no longer piece, so
texts fall apart there; equal parts are looked up instead of encoded again.
"""

from __future__ import annotations

import codecs
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

BLANK = "▁"
#: Parts of texts and pairs of tokens that a worker remembers, and characters up to which a part is worth it.
PARTS = 500_000
PAIRS = 2_000_000
PART_LENGTH = 64
#: Ids up to which Arrow joins a batch at once: its offsets have 32 bits.
BULK = 50_000_000


def _replace_byte(error):
    return "�", error.start + 1


codecs.register_error("cadenza_each_byte", _replace_byte)


class PieceCodec:
    """The merges of a model with byte fallback, a dummy prefix, and no other normalisation.

    pieces gives (piece, id, score) of the ordinary pieces, bytes_ the 256 ids of byte pieces, others
    what remaining ids decode to.
    """

    def __init__(self, pieces: list[tuple[str, int, float]], bytes_: list[int], others: dict[int, str] | None = None):
        self.ids = {p: i for p, i, _ in pieces}
        self.rank = {p: -score for p, _, score in pieces}
        self.bytes = bytes_
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.codes: dict[str, bytes] = {}
        self.spines: dict[str, tuple[list, list]] = {}
        self._build(p for p in self.ids if len(p) == 1 or self._merged(p) is not None)
        joined = sorted({c for p in self.ids if len(p) > 1 for c in p} - {BLANK})
        whole = re.compile(r".+", re.S)
        crossing = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.splitter = whole if crossing or not joined else re.compile(f"{BLANK}*[{''.join(map(re.escape, joined))}]+|{BLANK}+|.", re.S)
        self.bytes_of = {i: p.replace(BLANK, " ").encode() for p, i, _ in pieces} | {i: t.encode() for i, t in (others or {}).items()}
        self.bytes_of |= {i: bytes([b]) for b, i in enumerate(bytes_)}
        self.by_id = pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)], pa.binary())
        self.led = {i for p, i, _ in pieces if p.startswith(BLANK)}
        self.mute = {i for i, text in self.bytes_of.items() if not text}

    @classmethod
    def load(cls, path: str) -> PieceCodec:
        """Read a model file; models that merge or normalise in another way are refused."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" ﬁＡ  a\n ") != f"{BLANK}{BLANK}ﬁＡ{BLANK}{BLANK}a\n{BLANK}":
            raise ValueError(f"{path} doesn't keep texts as they are behind one blank")
        pieces, bytes_, others = [], {}, {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(piece[3:5], 16)] = i
            elif sp.is_control(i):
                others[i] = ""
            elif sp.is_unknown(i):
                others[i] = " ⁇ "
            elif sp.is_unused(i):
                raise ValueError(f"{path} has unused pieces")
            else:
                pieces.append((piece, i, sp.get_score(i)))
        if len(bytes_) != 256:
            raise ValueError(f"{path} has no byte fallback")
        return cls(pieces, [bytes_[b] for b in range(256)], others)

    def _merged(self, text: str) -> list[tuple[float, int, int]] | None:
        """(rank, start, middle) of the merges of a text, in order, if they end in one token; rank is how late a merge comes."""
        at = list(range(len(text) + 1))  # borders of the tokens left
        done = []
        while len(at) > 2:
            found = [(self.rank[text[at[k] : at[k + 2]]], at[k], k) for k in range(len(at) - 2) if text[at[k] : at[k + 2]] in self.rank]
            if not found:
                return None
            rank, start, k = min(found)
            done.append((rank, start, at[k + 1]))
            del at[k + 1]
        return done

    def _spine(self, token: str) -> tuple[list, list]:
        """Tokens at the left and at the right edge of a token while it grows, each with the rank at which it is merged away."""
        have = self.spines.get(token)
        if have is None:
            left, right = [], []
            a, b = token[:1], token[-1:]
            # merges in order; an edge changes with each merge that takes it in
            ends = {k: k + 1 for k in range(len(token))}
            low = len(token) - 1
            highest = -float("inf")
            for rank, start, middle in self._merged(token) or []:
                highest = max(highest, rank)
                if start == 0:
                    left.append((a, highest))
                    a = token[: ends[middle]]
                if middle == low:
                    right.append((b, highest))
                    low = start
                    b = token[start:]
                ends[start] = ends.pop(middle)
            left.append((a, float("inf")))
            right.append((b, float("inf")))
            self.spines[token] = have = (left, right)
        return have

    def compatible(self, a: str, b: str) -> bool:
        """Whether the merges of a + b give a and b."""
        have = self.pairs.get((a, b))
        if have is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = have = self._compatible(a, b)
        return have

    def _compatible(self, a: str, b: str) -> bool:
        right, left = self._spine(a)[1], self._spine(b)[0]
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = right[i], left[j]
            across = self.rank.get(x + y)
            # of equal ranks the leftmost merges first: x's own, then the crossing one, then y's
            if across is not None and across < x_goes and across <= y_goes:
                return False
            if x_goes == y_goes == float("inf"):
                return True
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1

    def _build(self, words) -> None:
        """An automaton over words: moves of each state by character, and the words that end in it, the longest first."""
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[tuple] = [()]
        for word in words:
            state = 0
            for c in word:
                after = self.moves[state].setdefault(c, len(self.moves))
                if after == len(self.moves):
                    self.moves.append({})
                    self.ends.append(())
                state = after
            self.ends[state] = ((word, len(word)),)
        self.falls = [0] * len(self.moves)  # where the longest shorter suffix of a state stands
        queue = list(self.moves[0].values())
        for state in queue:
            for c, after in self.moves[state].items():
                fall = self.falls[state]
                while fall and c not in self.moves[fall]:
                    fall = self.falls[fall]
                self.falls[after] = self.moves[fall].get(c, 0)
                queue.append(after)
            self.ends[state] += self.ends[self.falls[state]]

    def _move(self, state: int, c: str) -> int:
        """The state after a character that goes on from a shorter suffix; kept, so that it is looked up from then on."""
        fall = state
        while fall and c not in self.moves[fall]:
            fall = self.falls[fall]
        after = self.moves[fall].get(c, 0)
        if c in self.moves[0]:  # characters of no piece aren't kept, so that what is kept is bounded
            self.moves[state][c] = after
        return after

    def tables(self, texts):
        """(text, last token of each of its prefixes by length) for parts of texts, whose blanks are already BLANK. Characters without a piece are tokens of their own.

        A text that begins as the one before it goes on from their common prefix, so sorted texts share
        most of their tables. The table is the same list each time.
        """
        last, states, old = [""], [0], ""
        moves, ends, known = self.moves, self.ends, self.pairs.get
        for text in texts:
            same = 0
            for c, d in zip(text, old, strict=False):
                if c != d:
                    break
                same += 1
            del last[same + 1 :], states[same + 1 :]
            state = states[same]
            for n in range(same + 1, len(text) + 1):
                c = text[n - 1]
                after = moves[state].get(c)
                state = self._move(state, c) if after is None else after
                for piece, size in ends[state]:
                    before = last[n - size]
                    if not before:
                        break
                    fits = known((before, piece))
                    if self.compatible(before, piece) if fits is None else fits:
                        break
                else:
                    piece = c
                last.append(piece)
                states.append(state)
            old = text
            yield text, last

    def tokens(self, text: str) -> list[str]:
        """Tokens of one part of a text."""
        return [t for _, last in self.tables([text]) for t in self._back(text, last)]

    @staticmethod
    def _back(text: str, last: list[str]) -> list[str]:
        """Tokens from the last one backwards, in order."""
        out = []
        at = len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _code(self, token: str) -> bytes:
        """Ids of a token as 32-bit numbers; a character without a piece is its bytes."""
        found = self.codes.get(token)
        if found is None:
            own = self.ids.get(token)
            found = np.array([own] if own is not None else [self.bytes[b] for b in token.encode("utf-8", "replace")], "int32").tobytes()
            if own is not None:
                self.codes[token] = found
        return found

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; empty texts have none. Parts that aren't known yet are sorted and encoded once."""
        found = [self.splitter.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        parts = self.parts
        asked = set().union(*found)
        new = asked.difference(parts)
        if len(parts) + len(new) > PARTS:
            parts.clear()
            new = asked
        code = self._code
        for part, last in self.tables(sorted(new)):
            parts[part] = b"".join(map(code, self._back(part, last)))
        out = [np.frombuffer(b"".join(map(parts.__getitem__, f)), "int32") for f in found]
        for part in new:
            if len(part) > PART_LENGTH:
                del parts[part]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of byte pieces read as UTF-8 (a byte that can't be read gives U+FFFD), the first blank dropped."""
        if not ids:
            return ""
        runs, text = [ids], ""
        if not self.mute.isdisjoint(ids):  # control ids have no text, but bytes beside them aren't read together
            cuts = [-1, *(k for k, i in enumerate(ids) if i in self.mute), len(ids)]
            runs = [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False) if a + 1 < b]
        for run in runs:
            text += b"".join(map(self.bytes_of.__getitem__, run)).decode("utf-8", "cadenza_each_byte")
        return text[1:] if runs and runs[0][0] in self.led else text

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """decode() for an array of lists of ids; pieces are taken and joined by Arrow. Null lists and null ids are read as absent."""
        if len(lists.values) > BULK or lists.null_count or lists.values.null_count or not self.mute.isdisjoint(np.unique(lists.flatten().to_numpy()).tolist()):
            return pa.array([self.decode([i for i in x or () if i is not None]) for x in lists.to_pylist()], pa.string())
        pieces = pa.ListArray.from_arrays(lists.offsets, pc.take(self.by_id, lists.values))
        first = np.concatenate([lists.values.to_numpy(), [-1]])[lists.offsets.to_numpy()[:-1]]
        led = np.isin(first, list(self.led)) & (np.diff(lists.offsets.to_numpy()) > 0)
        joined = [x.decode("utf-8", "cadenza_each_byte") for x in pc.binary_join(pieces, b"").to_pylist()]
        return pa.array([x[1:] if b else x for x, b in zip(joined, led.tolist(), strict=True)], pa.string())


@cache
def codec(path: str) -> PieceCodec:
    return PieceCodec.load(path)


def _mapped(df: DataFrame, column: str, out: str, kind: str, work) -> DataFrame:
    """df with `out`, what work gives for Arrow batches of `column`."""
    small_batches(df.sparkSession, 1024)
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, work(batch.column(at))], names=names)

    names = [f"c{i}" for i in range(len(df.columns))] + ["made"]
    plain = df.toDF(*names[:-1])
    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, [*plain.dtypes, ("", kind)], strict=True))
    return plain.mapInArrow(run, schema).toDF(*df.columns, out)


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each text as an array; null texts are read as empty, and empty ones have no ids.

    path names the model on every executor. Other columns, repeated rows and empty tables pass as they
    are; `out` may not be the name of a column of df. Texts of any length are encoded whole.
    """

    def work(texts):
        own = codec(path)
        found = own.encode_all([t or "" for t in texts.cast(pa.string()).to_pylist()])
        sizes = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        values = np.concatenate(found) if found else np.zeros(0, "int32")
        return pa.ListArray.from_arrays(pa.array(sizes.astype("int32")), pa.array(values))

    return _mapped(df, text_col, out, "array<int>", work)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each array of ids; null arrays and null ids are read as absent, an id beyond the model is an error. See encode()."""

    def work(lists):
        return codec(path).decode_lists(lists)

    return _mapped(df, ids_col, out, "string", work)


def op12_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded; nulls, repeats and empty tables as encode() says."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, path).select("doc_id", "ids"), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
