"""Op 7: SentencePiece encoding and decoding with a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import build, col, slices
from .wordcache import ChunkCache, encoded

SPACE = "▁"
#: Longest text whose agenda is a plain list.
SHORT, NEVER = 48, 1 << 60
#: Chunks whose ids a worker keeps (about 200 bytes each); only speed and memory depend on it.
HELD_CHUNKS = 1_000_000
CHUNK = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class MergeEncoder:
    """Ids of a merge-type vocabulary with byte fallback.

    Merges run in order of score, ties from the left, on a heap of adjacent pairs. Texts are cut where no piece of the
    vocabulary can cross: before a space mark that follows another character, and around line breaks if no piece holds
    one. Every chunk is encoded by the agenda once per cache life and its ids are compared with the library's; texts with other
    blanks than single ones go through the agenda whole and are compared too.
    """

    def __init__(self, model: str, verify: bool = True, held: int = HELD_CHUNKS):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.verify, self.unk = verify, sp.unk_id()
        self.byte_id, self.id, score = {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                if sp.is_unused(i):
                    raise ValueError("vocabularies with unused pieces are not supported")
                self.id[piece], score[piece] = i, sp.get_score(i)
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.order = {p: place[s] for p, s in score.items()}
        crosses = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.cut = not crosses and not any("\n" in p for p in self.id) and bool(self.byte_id)
        self.cache = ChunkCache(self._fresh, held)

    def agenda(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        sym = self._merge_short(list(text)) if len(text) <= SHORT else self._merge_long(list(text))
        ids, out = self.id, []
        for s in sym:
            i = ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in s.encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def _merge_short(self, sym: list[str]) -> list[str]:
        """The agenda of a short text: the order of each adjacent pair, the first of the smallest is next."""
        get, never = self.order.get, NEVER
        agenda = [get(p, never) for p in map(str.__add__, sym, sym[1:])]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            sym[i] += sym.pop(i + 1)
            agenda.pop(i)
            if i < len(agenda):
                agenda[i] = get(sym[i] + sym[i + 1], never)
            if i:
                agenda[i - 1] = get(sym[i - 1] + sym[i], never)
        return sym

    def _merge_long(self, sym: list[str]) -> list[str]:
        """The agenda of a long text: a heap of (order, place, length); entries whose pair has changed are passed over."""
        get, n = self.order.get, len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i, r in enumerate(map(get, map(str.__add__, sym, sym[1:]))) if r is not None]
        heapify(heap)
        while heap:
            _, left, size = heappop(heap)
            right = nxt[left]
            if not sym[left] or right >= n or len(sym[left]) + len(sym[right]) != size:
                continue
            sym[left], sym[right] = sym[left] + sym[right], ""
            after = nxt[left] = nxt[right]
            before = prv[left]
            if after < n:
                prv[after] = left
                if (r := get(sym[left] + sym[after])) is not None:
                    heappush(heap, (r, left, len(sym[left]) + len(sym[after])))
            if before >= 0 and (r := get(sym[before] + sym[left])) is not None:
                heappush(heap, (r, before, len(sym[before]) + len(sym[left])))
        return [s for s in sym if s]

    def _fresh(self, keys: list[str]) -> list[list[int]]:
        """Keys are ``word`` for a word behind one space mark, a line break and a text for one that begins a line."""
        ids = [self.agenda(k if k[:1] == "\n" else SPACE + k) for k in keys]
        if self.verify:
            for k, mine, theirs in zip(keys, ids, self.lib.encode(keys, num_threads=1), strict=True):
                theirs = theirs[1:] if k[:1] == "\n" else theirs
                if mine != theirs:
                    raise RuntimeError(f"agenda and library differ on {k!r}: {mine} and {theirs}")
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's end."""
        norms = [self.lib.normalize(t) for t in texts]
        keys = [self._keys(n) for n in norms]
        odd = [i for i, k in enumerate(keys) if k is None]
        plain = [self._plain(norms[i]) for i in odd]
        if self.verify and plain != self.lib.encode([texts[i] for i in odd], num_threads=1):
            raise RuntimeError("agenda and library differ on a text with blanks that don't stand alone")
        return encoded(self.cache, keys, plain)

    def _keys(self, norm: str) -> list[str] | None:
        """Cache keys of a text whose words are single-spaced, else None."""
        if not norm:
            return []
        if not self.cut or SPACE * 2 in norm or norm[0] != SPACE or norm[-1] == SPACE or f"{SPACE}\n" in norm or f"\n{SPACE}" in norm:
            return None
        first, *lines = norm[1:].split("\n")
        keys = first.split(SPACE)
        for line in lines:
            head, *words = line.split(SPACE)
            keys.append("\n" + head)
            keys += words
        return keys

    def _plain(self, norm: str) -> list[int]:
        """Any text: chunks begin where a space mark follows another character, and around line breaks."""
        if not self.cut:
            return self.agenda(norm)
        return list(chain.from_iterable(map(self.agenda, CHUNK.findall(norm))))


@lru_cache(2)
def encoder(model: str, verify: bool, held: int) -> MergeEncoder:
    return MergeEncoder(model, verify, held)


def piece_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True, held: int = HELD_CHUNKS) -> DataFrame:
    """``id_col``, ids array<int> and decoded string of every row; no begin or end ids.

    ``model`` is a path that every executor can open. Null texts count as empty: no ids, decoded empty. Null and
    repeated ids are kept row by row, other columns are ignored, an empty table gives an empty one. Texts are encoded
    whole; nothing is shuffled.
    """
    src = docs.select(col(id_col).alias("key"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        enc = encoder(model, verify, held)
        for whole in batches:
            schema = pa.schema([("key", whole.schema.field(0).type), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
            for batch in slices(whole, 1):
                flat, ends = enc.encode(batch.column(1).to_pylist())
                ends = np.concatenate([[0], ends])
                back = [enc.lib.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                yield build(schema, batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), back)

    key = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {key}, ids array<int>, decoded string").withColumnRenamed("key", id_col)


def piece_digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
