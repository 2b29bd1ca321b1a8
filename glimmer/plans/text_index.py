"""A stored full-text index that is kept up to date, and searches that read what can be among their results.

An index is a set of segments, each written once. A segment has its texts in order of their keys, in blocks of 1,024, and
`postings` with a row for each term and block (several where a batch cuts a block; searches add them up): keys, lengths, counts and positions of the block's texts that have the
term, and two bounds, the greatest count and the least length. Files are ordered by term, below a folder for each hash of
a term's first letter (`lead`), so words and prefixes prune folders and, by the terms' ranges, row groups.

Changed and deleted texts are marked in their old segments by bits, a row for each block that has any; a batch writes a
segment of its own. Texts and tokens are sums over segments less what is marked, and so equal a new index's. Segments of about the same size are merged once there are `FAN` of them, without what is
marked, so a text is rewritten a number of times that grows with the logarithm of the index's size. What an index consists
of is a note of one commit (sources.snapshots): searches see a batch whole or not at all, and of two writers one goes again.

A search first reads bounds and counts alone. They give each word's number of texts, the blocks that can hold a result at
all (AND needs all its words in the block), and no less than the best score each block can have. The blocks with the
highest bounds are scored; of the others those follow whose bound reaches the worst score that is kept. Results, ties and
scores are those of fts.search over the texts. Keys must be unique; texts without tokens count in totals.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.functions import text as T
from glimmer.functions.porter import stem as stem_word
from glimmer.functions.porter import stemmed
from glimmer.plans import fts
from glimmer.sources.snapshots import Conflict, Snapshots, View

LEADS, BLOCK, FAN, WAVE, RETRIES = 64, 1024, 4, 64, 10
#: Tokens that are inverted at a time, and texts whose postings of a lead go to one file.
LOT, SHARE = 1 << 20, 1 << 15
#: Bits of a block's number below its segment's number.
_SEGMENT_BITS = 43


def _lead(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 1)), F.lit(LEADS)).cast("int")


def _marked(bits: Column, ord_: Column) -> Column:
    """Whether a text of a block is marked; bits may be null."""
    word = F.element_at(bits, (F.shiftright(ord_, 6) + 1).cast("int"))
    return F.coalesce(F.getbit(word, ord_.bitwiseAND(F.lit(63))) == 1, F.lit(False))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of texts (key, dl, t, block, ord): a row for each term and block, and a further one where a block is cut, by
    the end of a batch or after about LOT tokens, which searches add up."""
    for b in batches:
        if not b.num_rows:
            continue
        dl, block = b.column(1).to_numpy().astype(np.int64), b.column(3).to_numpy()
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True):
            at = start
            while at < end:
                stop = max(at + 1, at + int(np.searchsorted(np.cumsum(dl[at:end]), LOT, "right")))
                part = b.slice(at, min(stop, end) - at)
                at = min(stop, end)
                tokens = part.column(2).flatten()
                if len(tokens):
                    yield _postings_of(part, tokens, dl[at - part.num_rows : at], int(block[start]))


def _postings_of(b: pa.RecordBatch, tokens: pa.Array, dl: np.ndarray, block: int) -> pa.RecordBatch:
    words = tokens.dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(dl)), dl)
    position = (np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)).astype(np.int32)
    order = np.argsort(code, kind="stable")
    code, row, position = code[order], row[order], position[order]
    pair = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
    tf = np.diff(np.append(pair, len(code))).astype(np.int32)
    term = np.flatnonzero(np.append(True, code[pair][1:] != code[pair][:-1]))
    ends = np.append(term, len(pair)).astype(np.int32)
    of, length = row[pair], dl[row[pair]].astype(np.int32)

    def lists(values) -> pa.Array:
        return pa.ListArray.from_arrays(ends, values)

    places = pa.ListArray.from_arrays(np.append(pair, len(code)).astype(np.int32), pa.array(position))
    columns = [
        words.dictionary.take(pa.array(code[pair][term])),
        pa.array(np.full(len(term), block)),
        pa.array(np.diff(ends)),
        pa.array(np.maximum.reduceat(tf, term)),
        pa.array(np.minimum.reduceat(length, term)),
        *map(lists, (b.column(4).take(pa.array(of)), b.column(0).take(pa.array(of)), pa.array(length), pa.array(tf), places)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "max_tf", "min_dl", "ords", "keys", "dls", "tfs", "positions"])


class TextIndex:
    """The index of that name in a store of tables, which may hold other tables too."""

    def __init__(self, store: Snapshots, name: str = "index", view: View | None = None):
        self.store, self.name, self.spark = store, name, store.spark
        self.base = f"{store.root}/{name}"
        self.view = view or store.view()

    @property
    def note(self) -> dict | None:
        return self.view.notes.get(self.name)

    def refreshed(self) -> TextIndex:
        """The index as the last commit has it."""
        return TextIndex(self.store, self.name)

    # --- tables

    def _texts(self, segments: list[dict]) -> DataFrame:
        read = self.spark.read.schema(f"key {self.note['kind']}, dl int, t array<string>, block long, ord int")
        return read.parquet(*(f"{self.base}/texts/segment={s['folder']}" for s in segments))

    def _postings(self, segments: list[dict]) -> DataFrame:
        kind = self.note["kind"]
        schema = f"term string, block long, n int, max_tf int, min_dl int, ords array<int>, keys array<{kind}>, dls array<int>, tfs array<int>, positions array<array<int>>, segment string, lead int"
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/postings").parquet(*(f"{self.base}/postings/segment={s['folder']}" for s in segments))

    @cached_property
    def postings(self) -> DataFrame:
        """Of all segments; their files are listed once."""
        return self._postings(self.note["segments"])

    def _marks(self, segments: list[dict]) -> DataFrame | None:
        """(block, bits) of the blocks with marked texts; None if there are none."""
        places = [s["marks"] for s in segments if s["marks"]]
        return self.spark.read.schema("block long, bits array<long>").parquet(*(f"{self.base}/marks/{p}" for p in places)) if places else None

    def _live(self, segments: list[dict]) -> DataFrame:
        texts, marks = self._texts(segments), self._marks(segments)
        return texts if marks is None else texts.join(marks, "block", "left").where(~_marked(F.col("bits"), F.col("ord"))).drop("bits")

    # --- writing

    def _segment(self, tokens: DataFrame, number: int) -> dict:
        """Write a segment of (key, t), in partitions by ranges of keys, and describe it."""
        folder = f"{number}-{uuid.uuid4().hex}"
        ordered = tokens.sortWithinPartitions("key").withColumn("_n", F.monotonically_increasing_id())
        at = F.col("_n")
        placed = ordered.select("key", F.size("t").alias("dl"), "t", (F.lit(number << _SEGMENT_BITS) + F.shiftright(at, BLOCK.bit_length() - 1)).alias("block"), at.bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("ord"))
        place = f"{self.base}/texts/segment={folder}"
        placed.write.parquet(place)
        texts = self.spark.read.schema(placed.schema).parquet(place)
        total = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        kind = placed.schema["key"].dataType.simpleString()
        inverted = texts.mapInArrow(_inverted, f"term string, block long, n int, max_tf int, min_dl int, ords array<int>, keys array<{kind}>, dls array<int>, tfs array<int>, positions array<array<int>>")
        # blocks are dealt to as many shares as the texts need, so that a frequent word lies in many files and none is large
        share = F.pmod(F.xxhash64(F.shiftright("block", 4)), F.lit(1 + total.texts // SHARE))
        inverted.withColumn("lead", _lead(F.col("term"))).repartition("lead", share).sortWithinPartitions("lead", "term", "block").write.partitionBy("lead").parquet(f"{self.base}/postings/segment={folder}")
        return {"folder": folder, "number": number, "texts": total.texts, "tokens": total.tokens, "gone": 0, "gone_tokens": 0, "marks": None}

    def rebuilt(self, texts: DataFrame, key: str, column: str = "text", stem: bool = False) -> dict:
        """Write texts as the index's only segment; the note to commit."""
        kind = texts.schema[key].dataType.simpleString()
        return {"kind": kind, "stem": stem, "next": 1, "segments": self._filled(self._segment(self._tokens(texts, key, column, stem), 0))}

    @staticmethod
    def _filled(segment: dict) -> list[dict]:
        return [segment] if segment["texts"] else []

    @staticmethod
    def _tokens(texts: DataFrame, key: str, column: str, stem: bool) -> DataFrame:
        """(key, t) in ranges of keys. Raw texts are moved and ordered; tokens, which take several times the room, are made of them after that."""
        ordered = texts.select(F.col(key).alias("key"), F.col(column).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
        tokens = T.tokens(F.col("text"))
        if stem:
            tokens = stemmed(tokens)
        return ordered.select("key", F.coalesce(tokens, F.array().cast("array<string>")).alias("t"))

    def changed(self, texts: DataFrame | None, removed: DataFrame | None, key: str, column: str = "text") -> dict:
        """Write a batch: texts that are new or replace those of their keys, and keys that are removed; the note to commit."""
        note = self.note
        segments = [dict(s) for s in note["segments"]]
        keys = [x.select(F.col(key).alias("key")) for x in (texts, removed) if x is not None]
        segments = self._without(segments, reduce(DataFrame.unionByName, keys).distinct())
        if texts is not None:
            segments += self._filled(self._segment(self._tokens(texts, key, column, note["stem"]), note["next"]))
        return self._merged(note | {"next": note["next"] + 1, "segments": segments})

    def _without(self, segments: list[dict], keys: DataFrame) -> list[dict]:
        """The segments with the texts of these keys marked."""
        if not segments:
            return segments
        hit = self._live(segments).select("key", "block", "ord", "dl").join(keys, "key", "left_semi").withColumn("number", F.shiftright("block", _SEGMENT_BITS)).persist()
        try:
            lost = {r.number: r for r in hit.groupBy("number").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).collect()}  # a row a segment
            touched = [s for s in segments if s["number"] in lost]
            if not touched:
                return segments
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("ord").bitwiseAND(F.lit(63)))
            word = F.shiftright("ord", 6)
            new = hit.groupBy("block").agg(F.array(*(F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")) for i in range(BLOCK // 64))).alias("bits"))
            old = self._marks(touched)
            both = new if old is None else new.unionByName(old)
            folded = both.groupBy("block").agg(F.array(*(F.bit_or(F.get("bits", F.lit(i))) for i in range(BLOCK // 64))).alias("bits"))
            place = uuid.uuid4().hex
            folded.withColumn("number", F.shiftright("block", _SEGMENT_BITS)).write.partitionBy("number").parquet(f"{self.base}/marks/{place}")
        finally:
            hit.unpersist()
        return [s | {"gone": s["gone"] + lost[s["number"]].n, "gone_tokens": s["gone_tokens"] + lost[s["number"]].tokens, "marks": f"{place}/number={s['number']}"} if s["number"] in lost else s for s in segments]

    def _merged(self, note: dict) -> dict:
        """The note with segments merged, as long as FAN of them are of about one size or one is marked for the most part."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in note["segments"]:
                live = s["texts"] - s["gone"]
                tiers.setdefault(int(math.log(max(live, 1), FAN)), []).append(s)
            full = next((x for x in tiers.values() if len(x) >= FAN), None) or next(([s] for s in note["segments"] if 2 * s["gone"] > s["texts"]), None)
            if full is None:
                return note
            reader = TextIndex(self.store, self.name, View(0, {}, {self.name: note}))
            one = reader._segment(reader._live(full).select("key", "t").repartitionByRange("key"), note["next"])
            rest = [s for s in note["segments"] if s not in full]
            note = note | {"next": note["next"] + 1, "segments": rest + self._filled(one)}

    def _committed(self, make) -> TextIndex:
        """make(index) written and committed, again if another writer was first."""
        for _ in range(RETRIES):
            fresh = self.refreshed()
            note = make(fresh)
            try:
                self.store.commit({}, {self.name: note}, since=fresh.view)
            except Conflict:
                continue
            return self.refreshed()
        raise Conflict(f"{self.name} changed {RETRIES} times meanwhile")

    def rebuild(self, texts: DataFrame, key: str, column: str = "text", stem: bool = False) -> TextIndex:
        return self._committed(lambda x: x.rebuilt(texts, key, column, stem))

    def upsert(self, texts: DataFrame, key: str, column: str = "text", removed: DataFrame | None = None) -> TextIndex:
        return self._committed(lambda x: x.changed(texts, removed, key, column))

    def delete(self, keys: DataFrame, key: str) -> TextIndex:
        return self._committed(lambda x: x.changed(None, keys, key))

    def vacuum(self) -> int:
        """Delete folders that the last commit doesn't use, so none may be in writing; how many went."""
        fs, now, gone = self.store._fs(), self.refreshed(), 0
        used = {f"segment={s['folder']}" for s in now.note["segments"]} | {s["marks"].split("/")[0] for s in now.note["segments"] if s["marks"]}
        for kind in ("texts", "postings", "marks"):
            place = self.store._path(self.name, kind)
            for status in fs.listStatus(place) if fs.exists(place) else ():
                if status.getPath().getName() not in used:
                    gone += fs.delete(status.getPath(), True)
        return gone

    # --- searching

    def search(self, query: str, key: str, column: str = "text", limit: int | None = None, strict: bool = False, key_tokens: int = 1, report: dict | None = None) -> DataFrame:
        """(key, score): what fts.search gives for the index's texts, words stemmed if the index's are. report gets the
        number of blocks that can hold results, and of those that were scored."""
        return _Search(self, query, column, limit or 200, strict, key_tokens, report).run(key)


def _lead_of(word: str) -> int:
    """_lead of a word, whose hash is this one with a sign; LEADS is a power of 2, so signs don't matter."""
    return xxhash.xxh64_intdigest(word[:1].encode(), 42) % LEADS


def _all(tests) -> str:
    return "(" + " AND ".join(tests) + ")"


class _Search:
    """One search: words of its phrases, bounds of blocks, and scores. Words hold letters and digits alone, so they stand
    in SQL as they are."""

    def __init__(self, index: TextIndex, query: str, column: str, limit: int, strict: bool, key_tokens: int, report: dict | None):
        note = index.note
        if note is None:
            raise LookupError(f"no index in {index.base}")
        self.index, self.spark, self.segments = index, index.spark, note["segments"]
        self.limit, self.key_tokens, self.kind, self.report = limit, key_tokens, note["kind"], report
        self.texts = sum(s["texts"] - s["gone"] for s in self.segments)
        self.average = sum(s["tokens"] - s["gone_tokens"] for s in self.segments) / max(self.texts, 1) + key_tokens
        tree = fts.parse(query, strict) if strict or query.strip() else None
        self.tree = fts.mapped(tree, stem_word) if tree is not None and note["stem"] else tree
        self.leaves = fts.leaves(self.tree)
        self.phrases = list(dict.fromkeys(p for x, _ in self.leaves for p in fts.phrases(x)))
        self.mine = [p for p in self.phrases if p.column in (None, column)]
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for p in self.mine for w in self._of(p)))}
        self.names = {p: f"f{i}" for i, p in enumerate(self.phrases)}
        self.scored = [p for x, counts in self.leaves if counts for p in fts.phrases(x)]
        self.marks = index._marks(self.segments) if self.segments else None

    @staticmethod
    def _of(p: fts.Phrase) -> list[tuple[str, bool]]:
        return [(w, p.prefix and i == len(p.words) - 1) for i, w in enumerate(p.words)]

    @staticmethod
    def _is(word: str, prefix: bool) -> str:
        return f"startswith(term, '{word}')" if prefix else f"term = '{word}'"

    def _tree(self, node, leaf) -> str:
        """The tree as SQL, leaf(node) for its leaves."""
        if not isinstance(node, fts.Op):
            return leaf(node)
        left, right = self._tree(node.left, leaf), self._tree(node.right, leaf)
        return f"({left} AND {right})" if node.kind == "AND" else f"({left} OR {right})" if node.kind == "OR" else f"({left} AND NOT {right})"

    def _rows(self, words) -> DataFrame:
        """Postings of the words, with the marks of their blocks."""
        leads = ", ".join(str(n) for n in sorted({_lead_of(w) for w, _ in words}))
        rows = self.index.postings.where(f"lead IN ({leads}) AND ({' OR '.join(self._is(*w) for w in words)})")
        return rows if self.marks is None else rows.join(self.marks, "block", "left")

    @property
    def _unmarked(self) -> str:
        """Whether ord isn't marked."""
        return "coalesce(getbit(element_at(bits, CAST(shiftright(ord, 6) + 1 AS INT)), ord & 63), 0) = 0"

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """For each block and word: texts that have it, the greatest count and the least length."""
        live = "n" if self.marks is None else f"IF(bits IS NULL, n, size(filter(ords, ord -> {self._unmarked})))"
        each = rows.selectExpr("term", "block", f"CAST({live} AS BIGINT) AS live", "max_tf", "min_dl").where("live > 0")
        columns = []
        for w, i in self.words.items():
            columns += [F.expr(f"{fn}(CASE WHEN {self._is(*w)} THEN {c} END) AS {name}{i}") for fn, c, name in (("sum", "live", "df"), ("sum", "max_tf", "tf"), ("min", "min_dl", "dl"))]
        return each.groupBy("block").agg(*columns)

    def _has(self, p: fts.Phrase) -> str:
        """Whether a block has all words of a phrase."""
        return _all(f"df{self.words[w]} IS NOT NULL" for w in self._of(p)) if p in self.mine else "false"

    def _possible(self, node) -> str:
        """Whether a block can have a text that the tree holds for; what is right of NOT can't tell."""
        if isinstance(node, fts.Op) and node.kind == "NOT":
            return self._possible(node.left)
        if isinstance(node, fts.Op):
            return f"({self._possible(node.left)} {node.kind} {self._possible(node.right)})"
        return _all(map(self._has, fts.phrases(node)))

    def _bound(self) -> str:
        """No less than the score of any text of a block; sums may be rounded otherwise than scores."""
        parts = []
        for p in self.scored:
            if p in self.mine:
                at = [self.words[w] for w in self._of(p)]
                tf, dl = (f"{fn}({', '.join(f'{c}{i}' for i in at)})" if len(at) > 1 else f"{c}{at[0]}" for fn, c in (("least", "tf"), ("greatest", "dl")))
                part = fts.share(fts.idf_sql(f"{self.texts}L", f"{self.names[p]}_df"), tf, f"({dl} + {self.key_tokens})", f"{self.average!r}D")
                parts.append(f"IF({self._has(p)}, {part}, 0D)")
        return f"({' + '.join(parts) or '0D'}) * {1 + 1e-9!r}D"

    def _counted(self, rows: DataFrame, phrases: list[fts.Phrase]) -> DataFrame:
        """key, length and each phrase's occurrences, of the texts in these postings; with places where they are needed."""
        placed = any(len(p.words) > 1 for p in phrases) or any(isinstance(x, fts.Near) for x, _ in self.leaves)
        value = "positions" if placed else "tfs"
        flat = rows.selectExpr("block", "term", *([] if self.marks is None else ["bits"]), f"inline(arrays_zip(ords, keys, dls, {value})) AS (ord, key, dl, v)")
        if self.marks is not None:
            flat = flat.where(self._unmarked)
        mine = [p for p in phrases if p in self.mine]
        words = {w: i for w, i in self.words.items() if any(w in self._of(p) for p in mine)}
        fold = "sort_array(flatten(collect_list(CASE WHEN {} THEN v END)))" if placed else "coalesce(sum(CASE WHEN {} THEN v END), 0L)"
        lists = flat.groupBy("block", "ord", "key", "dl").agg(*(F.expr(f"{fold.format(self._is(*w))} AS w{i}") for w, i in words.items()))
        length = f"dl + {self.key_tokens} AS length"
        if not placed:
            return lists.selectExpr("key", length, *(f"{f'w{words[self._of(p)[0]]}' if p in mine else '0'} AS {self.names[p]}" for p in phrases))

        def starts(p: fts.Phrase) -> str:
            if p not in mine:
                return "CAST(array() AS ARRAY<INT>)"
            first, *rest = [f"w{words[w]}" for w in self._of(p)]
            # each list is moved to where the phrase would start, and the shifted lists are intersected
            return reduce(lambda a, b: f"array_intersect({a}, {b})", (f"transform({c}, x -> x - {k})" for k, c in enumerate(rest, 1)), first)

        found = lists.selectExpr("key", length, *(f"{starts(p)} AS {self.names[p]}_at" for p in phrases))
        return found.selectExpr("*", *(f"size({self.names[p]}_at) AS {self.names[p]}" for p in phrases))

    def _leaf(self, node) -> str:
        tests = [f"{self.names[p]} > 0" for p in fts.phrases(node)]
        if isinstance(node, fts.Near):
            first, *rest = node.phrases
            n, d = len(first.words), node.distance
            near = [f"exists({self.names[p]}_at, j -> j - i - {n} <= {d} AND i - j - {len(p.words)} <= {d} AND i <> j)" for p in rest]
            tests += [f"exists({self.names[first]}_at, i -> {x})" for x in near]
        return _all(tests)

    def _hits(self, rows: DataFrame, dfs: dict[fts.Phrase, int]) -> DataFrame:
        parts = [fts.share(f"{fts.idf(self.texts, dfs[p])!r}D", self.names[p], "length", f"{self.average!r}D") for p in self.scored]
        found = self._counted(rows, self.phrases).where(self._tree(self.tree, self._leaf)).selectExpr("key", f"{' + '.join(parts)} AS score")
        return found.orderBy(F.col("score").desc(), "key").limit(self.limit)

    def run(self, key: str) -> DataFrame:
        if self.tree is None or not self.mine or not self.segments:
            return self._none(key)
        rows = self._rows(self.words)
        blocks = self._blocks(rows)
        # how many texts have a phrase or a prefix is known from their places alone
        complex_ = [p for p in self.mine if len(p.words) > 1 or p.prefix]
        exact = self._frequencies(blocks, complex_) if complex_ else {}
        sums = [f"{exact[p]}L AS {self.names[p]}_df" if p in exact else f"coalesce(sum(df{self.words[self._of(p)[0]]}), 0L) AS {self.names[p]}_df" for p in self.mine]
        stats = blocks.agg(*map(F.expr, sums))
        bounds = blocks.crossJoin(F.broadcast(stats)).where(self._possible(self.tree)).withColumn("bound", F.expr(self._bound()))  # stats is one row
        head = bounds.orderBy(F.col("bound").desc(), "block").limit(WAVE + 1).collect()
        if self.report is not None:
            self.report |= {"blocks": len(head), "scored": min(len(head), WAVE)}
        if not head:
            return self._none(key)
        dfs = dict.fromkeys(self.phrases, 0) | {p: head[0][f"{self.names[p]}_df"] for p in self.mine}
        first = ", ".join(str(r.block) for r in head[:WAVE])
        hits = self._hits(rows.where(f"block IN ({first})"), dfs)
        if len(head) > WAVE:
            best = hits.collect()  # at most `limit` rows
            least = best[-1].score if len(best) == self.limit else 0.0
            late = bounds.where(f"bound >= {least!r}D AND block NOT IN ({first})").select("block")
            if self.report is not None:
                self.report |= {"blocks": bounds.count(), "scored": WAVE + late.count()}
            hits = self.spark.createDataFrame([tuple(r) for r in best], f"key {self.kind}, score double")
            if head[WAVE].bound >= least:
                hits = hits.unionByName(self._hits(rows.join(late, "block", "left_semi"), dfs)).orderBy(F.col("score").desc(), "key").limit(self.limit)
        return hits.withColumnRenamed("key", key)

    def _none(self, key: str) -> DataFrame:
        return self.spark.createDataFrame([], f"key {self.kind}, score double").withColumnRenamed("key", key)

    def _frequencies(self, blocks: DataFrame, phrases: list[fts.Phrase]) -> dict[fts.Phrase, int]:
        """How many texts have each of the phrases; blocks without one's words aren't read."""
        whole = blocks.where(" OR ".join(map(self._has, phrases))).select("block")
        rows = self._rows({w for p in phrases for w in self._of(p)}).join(whole, "block", "left_semi")
        counts = self._counted(rows, phrases).agg(*(F.expr(f"count_if({self.names[p]} > 0) AS {self.names[p]}") for p in phrases)).first()
        return {p: counts[self.names[p]] for p in phrases}


def write(texts: DataFrame, path: str, key: str, column: str = "text", stem: bool = False) -> str:
    """Write the index of texts, over one that may lie there; the path is returned."""
    TextIndex(Snapshots(texts.sparkSession, path)).rebuild(texts, key, column, stem)
    return path


def search(spark: SparkSession, path: str, query: str, key: str, column: str = "text", limit: int | None = None, strict: bool = False, key_tokens: int = 1) -> DataFrame:
    """(key, score): what fts.search gives for the texts that the index has now."""
    return TextIndex(Snapshots(spark, path)).search(query, key, column, limit, strict, key_tokens)
