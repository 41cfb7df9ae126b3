"""SentencePiece BPE encoding by backtracking, and decoding.

A token sequence is the BPE encoding of its text exactly when each pair of neighbours
is: merging the joined text of the two again must give the two. So a text is encoded
left to right, by the longest match that is compatible with the token before it; where
none is, a bit marks the place as failed and the last token is taken back for its next
shorter one. No bit is set twice, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.llm.common import field, map_batches, numbered, per_process, text_of

#: Stretches that a Python worker remembers in each of two generations, pairs of tokens that it remembers, the longest
#: stretch remembered, in characters, and stretches matched in one pass.
REMEMBERED, PAIRS, LONGEST, MATCHED = 200_000, 600_000, 64, 1024
SPACE = "▁"
_LETTER = r"[^\W\d_]"
# Kinds of pieces in the model file.
_NORMAL, _UNKNOWN, _CONTROL, _DEFINED, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class Codec:
    """Encoder and decoder for one model file of kind BPE without a character map."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        rules = spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or spec.trainer_spec.model_type != 2 or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that leave the text as it is")
        if kinds & {_DEFINED, _UNUSED}:
            raise ValueError("only models without user-defined or unused pieces")
        self.prefix = rules.add_dummy_prefix
        self.escape = rules.escape_whitespaces
        self.pieces = [(p.piece, p.type) for p in spec.pieces]
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == _UNKNOWN)
        self.unknown_text = spec.trainer_spec.unk_surface
        self.byte_ids = [0] * 256
        self.bytes_of = {}
        for i, p in enumerate(spec.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[1:-1], 16)])
        self.fallback = len(self.bytes_of) == 256
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == _NORMAL}
        # Tokens that merging can reach; others are never part of an encoding.
        traces = {t: self._trace(t) for t in self.ids}
        whole = {t: i for t, i in self.ids.items() if traces[t][-1][1] == t}
        self.traces = {i: traces[t] for t, i in whole.items()}
        self.longest = ahocorasick.Automaton()
        for t, i in whole.items():
            self.longest.add_word(t[::-1], i)
        self.longest.make_automaton()
        self.text_of = [p.piece for p in spec.pieces]
        self.size_of = [len(t) for t in self.text_of]
        self.name_of = [str(i) for i in range(len(self.text_of))]
        # The next shorter token that a token begins with, or none.
        self.shorter = [-1] * len(self.text_of)
        for t, i in whole.items():
            self.shorter[i] = next((whole[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in whole), -1)
        self.letters = {t for t in whole if len(t) == 1}
        self.plain = [self._plain(piece, kind) for piece, kind in self.pieces]
        self.fits: dict[int, bool] = {}
        # Stretches met of late and before: number of ids, the ids joined by commas, what they decode to.
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}
        self.cut = self._units()

    def _units(self) -> re.Pattern | None:
        """Units that no token crosses: a space symbol after another character starts one, and so does, with
        few exceptions that the vocabulary names, the edge of a run of letters."""
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids):
            return None
        pairs = {t[i:i + 2] for t in self.ids for i in range(len(t) - 1) if SPACE not in t[i:i + 2]}
        letter = re.compile(_LETTER).fullmatch
        joined: dict[str, str] = {}
        for x, y in sorted(pairs):
            if bool(letter(x)) != bool(letter(y)):
                joined[y] = joined.get(y, "") + x
        # Not between characters that some token holds side by side.
        edge = "(?!" + "|".join(f"(?<=[{re.escape(x)}]){re.escape(y)}" for y, x in joined.items()) + ")" if joined else ""
        return re.compile(f"{SPACE}*(?:{_LETTER}++{edge}|(?:(?!{_LETTER})[^{SPACE}])++{edge}|[^{SPACE}]+)|{SPACE}+")

    def _trace(self, text: str) -> list[tuple[float | None, str, str]]:
        """Plain BPE of a short text: the pair whose union scores best is joined, the leftmost of equal ones.

        Per state the score of the pair joined next (none at the end), and the first and the last part.
        """
        parts, states, score = list(text), [], self.score
        while True:
            found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
            if not found:
                return [*states, (None, parts[0], parts[-1])]
            best, at = min(found)
            states.append((-best, parts[0], parts[-1]))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are when their joined text is merged again.

        Up to the first join across their edge each merges as it does alone, so the two
        known sequences are run side by side, the better score first, and the edge is watched.
        """
        key = a << 32 | b
        if key not in self.fits:
            if len(self.fits) >= PAIRS:
                self.fits = {}
            self.fits[key] = self._stay(self.traces[a], self.traces[b])
        return self.fits[key]

    def _stay(self, one: list[tuple[float | None, str, str]], two: list[tuple[float | None, str, str]]) -> bool:
        i = j = 0
        while True:
            left, _, last = one[i]
            right, first, _ = two[j]
            across = self.score.get(last + first)
            if across is not None and (left is None or across > left) and (right is None or across >= right):
                return False
            if left is None and right is None:
                return True
            if right is None or (left is not None and left >= right):
                i += 1
            else:
                j += 1

    def _matches(self, text: str) -> dict[int, int]:
        """The longest token that starts at each place, counted from the end: the longest that ends there in the reversed text."""
        # Of the tokens that end at one place the automaton names the longest first.
        return dict(reversed(list(self.longest.iter(text[::-1]))))

    def backtrack(self, matches: dict[int, int], start: int, stop: int, last: int) -> list[int]:
        """The encoding of the part ``start:stop`` of a text with last place ``last``, all of whose characters are tokens."""
        tokens: list[int] = []
        size_of, shorter, fits = self.size_of, self.shorter, self.fits
        failed, at, token, before = bytearray((stop - start) // 8 + 1), start, matches[last - start], -1
        while at < stop:
            while token >= 0:
                end = at + size_of[token]
                if end <= stop and not failed[(end - start) >> 3] >> ((end - start) & 7) & 1:
                    if before < 0:
                        break
                    fit = fits.get(before << 32 | token)
                    if fit or (fit is None and self.compatible(before, token)):
                        break
                token = shorter[token]
            if token < 0:
                failed[(at - start) >> 3] |= 1 << ((at - start) & 7)
                token = tokens.pop()
                before = tokens[-1] if tokens else -1
                at -= size_of[token]
                token = shorter[token]
            else:
                tokens.append(token)
                before = token
                at += size_of[token]
                token = matches[last - at] if at < stop else -1
        return tokens

    def _stretch(self, part: str, matches: dict[int, int], start: int, last: int) -> list[int]:
        """Ids of ``part``, which lies at ``start``; characters that no token holds become bytes, or the unknown id."""
        if self.letters.issuperset(part):
            return self.backtrack(matches, start, start + len(part), last)
        out, at = [], 0
        while at < len(part):
            if part[at] not in self.letters:
                out += [self.byte_ids[b] for b in part[at].encode()] if self.fallback else [self.unknown]
                at += 1
                continue
            end = at + 1
            while end < len(part) and part[end] in self.letters:
                end += 1
            out += self.backtrack(matches, start + at, start + end, last)
            at = end
        return out

    def stretches(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part; all are matched in one pass. No token crosses an edge: matches over one are cut back to shorter ones."""
        text = "".join(parts)
        matches, out, at = self._matches(text), [], 0
        for part in parts:
            out.append(self._stretch(part, matches, at, len(text) - 1))
            at += len(part)
        return out

    def _stretches(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE) if self.escape else text
        text = SPACE + text if self.prefix else text
        return self.cut.findall(text) if self.cut else [text]

    def _recall(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each text what is known of its stretches: number of ids, the ids joined by commas, what they decode to.

        Stretches that were not met for a generation are forgotten, long ones at once.
        """
        split = [self._stretches(t) for t in texts]
        young, old = self.young, self.old
        missing, fresh = set().union(*split).difference(young), []
        for part in missing:
            if part in old:
                young[part] = old[part]
            else:
                fresh.append(part)
        name_of = self.name_of
        for at in range(0, len(fresh), MATCHED):
            some = fresh[at:at + MATCHED]
            for part, ids in zip(some, self.stretches(some)):
                young[part] = (len(ids), ",".join([name_of[i] for i in ids]), self._bytes(ids))
        out = [[young[p] for p in parts] for parts in split]
        for part in fresh:
            if len(part) > LONGEST:
                del young[part]
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self._recall([text])[0] for i in ids.split(",")]

    def _plain(self, piece: str, kind: int) -> bytes | None:
        """What one id decodes to alone; none for a byte, whose neighbours count."""
        if kind == _BYTE:
            return None
        return b"" if kind == _CONTROL else (self.unknown_text if kind == _UNKNOWN else piece.replace(SPACE, " ")).encode()

    def _bytes(self, ids: list[int]) -> bytes:
        """What ids decode to, but for the dummy prefix; bytes that are no UTF-8 become replacement characters."""
        plain = [self.plain[i] for i in ids]
        if None not in plain:
            return b"".join(plain)
        out, run = [], []
        for i, own in [*zip(ids, plain), (None, b"")]:
            if own is None:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(_repaired(b"".join(run)))
                run = []
            out.append(own)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one leading space that stands for the dummy prefix goes."""
        first = next((i for i in ids if self.pieces[i][1] != _CONTROL), None)
        text = self._bytes(ids).decode()
        return text[1:] if self.prefix and first is not None and self.pieces[first][0].startswith(SPACE) else text

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text the number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        out = []
        for parts in self._recall(texts):
            ids, decoded = ",".join([p[1] for p in parts]), b"".join([p[2] for p in parts])
            if parts and self.prefix and self.pieces[int(parts[0][1].split(",", 1)[0])][0].startswith(SPACE):
                decoded = decoded[1:]
            out.append((sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out


def _repaired(data: bytes) -> bytes:
    """Valid UTF-8: each byte that starts no whole character becomes a replacement character."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                data[at:at + n].decode()
            except UnicodeDecodeError:
                continue
            if at + n <= len(data):
                out.append(data[at:at + n])
                at += n
                break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


def codec(path: str) -> Codec:
    """The codec of a model file, made once in a worker process, with what it remembers."""

    def make() -> Codec:
        with open(path, "rb") as file:
            return Codec(file.read())

    return per_process(f"codec {path}", make)


def encode_table(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, ids`` (array of int) of each whole text; null counts as empty and has no ids."""
    schema = T.StructType([T.StructField("row", T.LongType()), field(df, id_col, "id"), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [codec(model).encode(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "id", "ids"])

    return map_batches(numbered(df, id=F.col(f"`{id_col}`"), text=text_of(text_col)), run, schema)


def decode_table(df: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``row, id, text`` of each list of ids; null counts as empty."""
    schema = T.StructType([T.StructField("row", T.LongType()), field(df, id_col, "id"), T.StructField("text", T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [codec(model).decode(ids or []) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(texts, pa.string())], names=["row", "id", "text"])

    return map_batches(numbered(df, id=F.col(f"`{id_col}`"), ids=F.col(f"`{ids_col}`")), run, schema)


def digest_table(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of each row, from its encoding and the decoding of that.

    Null counts as empty; repeated rows are rows of their own; an empty table gives no
    rows; other columns are never read.
    """
    schema = T.StructType([
        field(df, id_col, "id"), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = codec(model).digests(batch.column("text").to_pylist())
        n, ids, decoded = zip(*got) if got else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(numbered(df, id=F.col(f"`{id_col}`"), text=text_of(text_col)), run, schema)
