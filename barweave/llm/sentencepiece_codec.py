"""SentencePiece BPE with a prefix table: each prefix of a chunk has one last token; ids come out backwards.

A text is cut at white-space marks, which no piece has after another character, so chunks are encoded alone
and remembered. In a chunk, an automaton over the pieces yields every piece that ends at a position; the last
token of the prefix that ends there is the one that is compatible with the last token of the prefix before it:
the two, side by side, are what merging them alone would give.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .common import id_and_text, map_texts

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NEVER = 1 << 60


class PieceModel:
    """Tables for a model of the kind BPE with byte fallback, identity normaliser and a dummy prefix.

    At most ``remember`` chunks and pairs are kept; then the memory starts anew, which changes no result."""

    def __init__(self, path: str, remember: int = 250_000):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with an identity normaliser and byte fallback are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.remember = remember
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 5)}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece goes on over white space")
        self.pieces = [p.piece for p in model.pieces]
        self.text_of = [str(i) for i in range(len(self.pieces))]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == 2}
        self.special = self.control | self.unknown | set(self.byte_of)
        self.unk_surface = model.trainer_spec.unk_surface
        # The time of the merge that makes a piece; single characters are there from the start.
        order = sorted((i for p, i in normal.items() if len(p) > 1), key=lambda i: (-model.pieces[i].score, i))
        self.time = dict.fromkeys(normal.values(), 0)
        self.time.update((i, t + 1) for t, i in enumerate(order))
        # Scores that tie would merge from the left in one go; the walk below needs distinct times.
        self.joined: dict[int, int] = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                if (a := normal.get(p[:cut])) is not None and (b := normal.get(p[cut:])) is not None:
                    self.joined[a << 20 | b] = self.time[i]
        self.halves: dict[int, tuple[int, int]] = {}
        self.single = {p for p in normal if len(p) == 1}
        auto = ahocorasick.Automaton()
        for p, i in normal.items():
            if len(p) > 1:
                halves = self._last_merge(p, normal)
                if halves is None:  # merging never makes this piece
                    continue
                self.halves[i] = halves
                auto.add_word(p, (i, len(p)))
        auto.make_automaton()
        self.auto = auto
        self.alone = {c: (normal[c], 1) for c in self.single}
        self.known = re.compile("[" + "".join(map(re.escape, sorted(self.single))) + "]*")
        self.pairs: dict[int, bool] = {}
        # Ids of words (chunks with one mark before them), of this generation and the one before.
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _last_merge(self, piece: str, normal: dict[str, int]) -> tuple[int, int] | None:
        ids = [normal.get(c) for c in piece]
        if None in ids:
            return None
        halves = None
        while len(ids) > 1:
            times = [self.joined.get(a << 20 | b, _NEVER) for a, b in zip(ids, ids[1:])]
            at = min(range(len(times)), key=times.__getitem__)
            if times[at] == _NEVER:
                return None
            halves = (ids[at], ids[at + 1])
            ids[at : at + 2] = [normal["".join(self.pieces[i] for i in halves)]]
        return halves

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging pieces a and b alone gives a, b: walk both back in time from the border; no merge
        over the border may have been due before those that made the pieces at it."""
        limit = _NEVER
        time, joined, halves = self.time, self.joined, self.halves
        while True:
            if joined.get(a << 20 | b, _NEVER) < limit:
                return False
            if time[a] > time[b]:
                limit = time[a]
                a = halves[a][1]
            elif time[b]:
                limit = time[b] + 1
                b = halves[b][0]
            else:
                return True

    def _encode_known(self, run: str) -> list[int]:
        """Ids of a run of characters that are all pieces themselves."""
        alone, pairs = self.alone, self.pairs
        last: list[tuple[int, int]] = []  # of each prefix: its last token, and that token's length
        at = 0
        for end, match in self.auto.iter(run):
            if end < at:
                continue
            while at < end:  # no longer piece fits there
                last.append(alone[run[at]])
                at += 1
            token, size = match
            if end >= size:
                key = last[end - size][0] << 20 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= 4 * self.remember:
                        pairs.clear()
                    ok = pairs[key] = self.compatible(key >> 20, token)
                if not ok:
                    continue
            last.append(match)
            at += 1
        for c in run[at:]:
            last.append(alone[c])
        ids, at = [], len(run) - 1
        while at >= 0:
            token, size = last[at]
            ids.append(token)
            at -= size
        ids.reverse()
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        if self.known.fullmatch(chunk):
            return self._encode_known(chunk)
        ids: list[int] = []
        run = ""
        for c in chunk:
            if c in self.single:
                run += c
                continue
            if run:
                ids += self._encode_known(run)
                run = ""
            ids += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return ids + (self._encode_known(run) if run else [])

    def _chunks_of(self, text: str):
        return _CHUNK.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self._chunks_of(text) for i in self.encode_chunk(c)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes in a row make UTF-8, a broken one U+FFFD; the mark of the start is dropped."""
        out: list[str] = []
        raw = bytearray()
        first = True

        def flush():
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()

        if self.special.isdisjoint(ids):
            text = "".join(map(self.pieces.__getitem__, ids)).replace(MARK, " ")
            return text[1:] if self.prefix and text.startswith(" ") else text
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                first = False
                continue
            flush()
            if i in self.control:
                continue
            if i in self.unknown:
                out.append(self.unk_surface)
                first = False
                continue
            piece = self.pieces[i]
            if first and self.prefix and piece.startswith(MARK):
                piece = piece[1:]
            first = False
            out.append(piece.replace(MARK, " "))
        flush()
        return "".join(out)

    def ids_text(self, text: str) -> str:
        """The decimal ids of a text, joined by commas."""
        if self.prefix != MARK or not text or MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return ",".join(map(str, self.encode(text)))
        return ",".join(self._ids_of_words(text.split(" ")))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids, sha256 of the text decoded from them."""
        joined = self.ids_text(text)
        if not joined:
            return 0, EMPTY, EMPTY
        ids = list(map(int, joined.split(",")))
        return len(ids), _sha(joined), _sha(self.decode(ids))

    def _ids_of_words(self, words: list[str]) -> list[str]:
        found = list(map(self.words.get, words))
        if None in found:
            text_of = self.text_of
            for at, ids in enumerate(found):
                if ids is None:
                    word = words[at]
                    ids = self.words.get(word) or self.older.get(word)
                    if ids is None:
                        ids = ",".join([text_of[i] for i in self.encode_chunk(MARK + word)])
                    if len(self.words) >= self.remember:
                        self.older, self.words = self.words, {}
                    self.words[word] = found[at] = ids
        return found


EMPTY = hashlib.sha256(b"").hexdigest()


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _utf8(raw: bytes) -> str:
    """Valid characters as they are; each byte that is part of none as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sentencepiece_digest(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, sha256 of the comma-joined ids, sha256 of the decoded text.

    A null text counts as empty: no ids, both digests of the empty string. Repeated rows each give a row; a
    null id is kept; other columns are ignored; an empty table gives no rows. Texts of any length are taken
    whole, chunk by chunk. The model's file is opened where the task runs (``model_path`` None: the installed
    public model). No shuffle.
    """

    def judge():
        model = load(model_path or default_model_path())
        return lambda texts: [model.digest(t or "") for t in texts]

    return map_texts(id_and_text(docs, id_col, text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string", judge)


def sentencepiece_encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: what ``sentencepiece_digest`` gives, the ids and the text decoded from them. Nulls and repeats as
    there."""

    def judge():
        model = load(model_path or default_model_path())

        def one(texts):
            rows = []
            for text in texts:
                joined = model.ids_text(text or "")
                ids = list(map(int, joined.split(","))) if joined else []
                decoded = model.decode(ids)
                rows.append((len(ids), _sha(joined), _sha(decoded), ids, decoded))
            return rows

        return one

    return map_texts(id_and_text(docs, id_col, text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string", judge)
