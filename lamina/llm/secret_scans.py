"""Secret scans in DataFrame operations only.

Base kinds are regular expressions. Positions come from splitting the text at the matches: the lengths of the
gaps and of the matches add up to the starts, so one pass gives all spans in code points. The method's own kind,
`entropy`, looks at candidate strings of at least MIN_CANDIDATE characters with letters and digits or mixed
case: a window of WINDOW characters slides over the string while an array of symbol counts and the sum of
c * log2(c) are updated by the character that enters and the one that leaves. Windows whose Shannon entropy
reaches the threshold of the string's character class (hexadecimal, alphanumeric, base64) give one span from the
first to the last of them. Base spans are cut out of a candidate first, and each part that is left and is long enough
is a candidate of its own. Allow-listed strings (identifiers with words, dates, counters, placeholders, paths) are
left out. Time grows in proportion to the text: candidates carry their own characters, spans are merged in one pass,
and a redacted text is put together from short chunks of it.

Results for unusual input: null and empty texts have no spans; a text of any length is scanned whole; repeated
rows get equal results; an empty table gives an empty result. Other columns are carried along, but ones named base_spans or
all_spans are replaced: pass the row as a struct.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import documents, text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough is matched from its start, as the leftmost match of the open-ended pattern is.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]
MIN_ASSIGNED = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_CANDIDATE = 20
WINDOW = 20
#: Bits a character that a window must reach, by the string's character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings that look random to a counter and are no secrets.
ALLOWED = [
    r"(?i)example|placeholder|changeme|dummy|sample|redacted",
    r"(?i)x{6,}|(.)\1{7,}",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^(?:[A-Za-z]+[_/=-]+)*[A-Za-z]+[0-9]{0,4}$",
    r"^(?:[A-Z]?[a-z]{2,}){2,}[0-9]{0,4}$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
]
#: Items of an array that are folded at once. Spark copies a fold's whole state at every step, so an array that grows in
#: it must stay short.
CHUNK = 256
#: Characters of the chunks that a text is cut into for redaction.
TEXT_CHUNK = 1024
#: Counts of the symbols in a window, COUNT_BITS each, as many to a long as fit.
COUNT_BITS = 5
COUNTS = 12

SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _folded(items: Column, state: dict[str, Column], step, kind: str, last=None) -> Column:
    """Everything that a fold over `items` emits, items of type `kind`. `step(s, x)` gives the new values of the
    fields of `state` and an array to emit; `last(s)` is emitted in the end."""

    def inner(s: Column, chunk: Column) -> Column:
        def one(s: Column, x: Column) -> Column:
            fields, more = step(s, x)
            return F.struct(*[v.alias(k) for k, v in fields.items()], F.concat(s["now"], more).alias("now"))

        return F.aggregate(chunk, F.struct(*[s[k].alias(k) for k in state], _none(kind).alias("now")), one)

    def outer(s: Column, chunk: Column) -> Column:
        return _let(inner(s, chunk), lambda i: F.struct(*[i[k].alias(k) for k in state], F.concat(s["full"], F.array(i["now"])).alias("full")))

    def whole(items: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))
        begin = F.struct(*[v.alias(k) for k, v in state.items()], _none(f"array<{kind}>").alias("full"))
        end = F.struct(*[v.alias(k) for k, v in state.items()])
        nothing = _let(end, last) if last else _none(kind)
        found = F.aggregate(chunks, begin, outer, lambda s: F.concat(F.flatten(s["full"]), last(s)) if last else F.flatten(s["full"]))
        return F.when(F.size(items) > 0, found).otherwise(nothing)

    return _let(items, whole)


def _matches(text: Column, pattern: str) -> Column:
    """`start, end, m` of all matches, m the matched string; for ASSIGN `v`, its group 2, too."""
    p = F.lit(pattern)

    def placed(whole: Column) -> Column:
        value = F.regexp_extract_all(text, p, F.lit(2)) if pattern == ASSIGN else whole
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), whole, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("n")))
        zero = {"at": F.lit(0).cast("long")}
        starts = _folded(sizes, zero, lambda s, x: ({"at": s["at"] + x["gap"] + x["n"]}, F.array(s["at"] + x["gap"])), "bigint")
        parts = F.arrays_zip(starts.alias("start"), whole.alias("m"), value.alias("v"))
        return F.transform(parts, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("m"), x["v"].alias("v")))

    found = _let(F.regexp_extract_all(text, p, F.lit(0)), placed)
    return F.when(F.rlike(text, p), found).otherwise(_none("struct<start:bigint,end:bigint,m:string,v:string>"))


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the pattern's matches for which `keep(value)` holds; the value is group 2 of ASSIGN, else the match."""
    found = F.filter(_matches(text, pattern), lambda x: keep(x["v"]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _hot_range(candidate: Column) -> Column:
    """`first, last` start (from 1) of the windows of the candidate whose entropy reaches its class's threshold;
    0, 0 if none does."""
    longs = -(-len(ALPHABET) // COUNTS)
    terms = F.array(*[F.lit(0.0)] + [F.lit(c * log2(c)) for c in range(1, WINDOW + 1)])
    least = (
        F.when(F.rlike(candidate, F.lit("^[0-9a-fA-F]+$")), THRESHOLDS["hex"])
        .when(F.rlike(candidate, F.lit("^[A-Za-z0-9]+$")), THRESHOLDS["alnum"])
        .otherwise(THRESHOLDS["base64"])
    )
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    empty = F.struct(*[F.lit(0).cast("long").alias(f"n{k}") for k in range(longs)], F.lit(0.0).alias("s"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def slide(codes: Column, terms: Column, most: Column) -> Column:
        # `old` is the symbol WINDOW places before, -1 while the window still fills
        leaving = F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), codes), 1, F.size(codes))

        def place(symbol: Column) -> Column:
            """The symbol's long and how far its count is shifted in it."""
            return F.struct(F.floor(symbol / COUNTS).cast("int").alias("k"), (COUNT_BITS * F.pmod(symbol, F.lit(COUNTS))).cast("int").alias("by"))

        moves = F.zip_with(codes, leaving, lambda a, b: F.struct(place(a).alias("new"), F.when(b >= 0, place(b)).alias("old"), (a == b).alias("same")))
        moves = F.transform(moves, lambda m, i: F.struct(m["new"].alias("new"), m["old"].alias("old"), m["same"].alias("same"), i.alias("at")))

        def count(s: Column, at: Column) -> Column:
            chosen = F.lit(None).cast("long")
            for k in reversed(range(longs)):
                chosen = F.when(at["k"] == k, s[f"n{k}"]).otherwise(chosen)
            return F.call_function("shiftrightunsigned", chosen, at["by"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

        def step(s: Column, m: Column) -> Column:
            new, full = m["new"], m["old"].isNotNull()
            one = F.call_function("shiftleft", F.lit(1).cast("long"), new["by"])
            out = F.call_function("shiftleft", F.lit(1).cast("long"), m["old"]["by"])
            entering, going = count(s, new), count(s, m["old"])
            change = terms[entering + 1] - terms[entering] + F.when(full, terms[F.greatest(going - 1, F.lit(0))] - terms[going]).otherwise(0.0)
            total = s["s"] + F.when(m["same"], 0.0).otherwise(change)
            hot = (m["at"] >= WINDOW - 1) & (total <= most)
            begin = m["at"] - WINDOW + 2
            counts = [(s[f"n{k}"] + F.when(new["k"] == k, one).otherwise(0) - F.when(full & (m["old"]["k"] == k), out).otherwise(0)).alias(f"n{k}") for k in range(longs)]
            return F.struct(*counts, total.alias("s"), F.when(hot & (s["first"] == 0), begin).otherwise(s["first"]).alias("first"), F.when(hot, begin).otherwise(s["last"]).alias("last"))

        return F.aggregate(moves, empty, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    # entropy = log2(WINDOW) - sum(c log2 c) / WINDOW >= least
    most = F.lit(float(WINDOW)) * (F.lit(log2(WINDOW)) - least) + F.lit(1e-9)
    return _let(codes, lambda c: _let(terms, lambda t: _let(most, lambda x: slide(c, t, x))))


def _candidate(value: Column) -> Column:
    """Whether a string is worth a look: symbols of two kinds, and not allow-listed."""
    kinds = sum((F.when(F.rlike(value, F.lit(p)), 1).otherwise(0) for p in ("[A-Z]", "[a-z]", "[0-9]")), F.lit(0))
    out = kinds >= 2
    for pattern in ALLOWED:
        out = out & ~F.rlike(value, F.lit(pattern))
    return out


def _parts(candidates: Column, base: Column) -> Column:
    """`start, m` of what is left of the candidates between the base spans, in one pass over both in order."""
    zero = F.lit(0).cast("long")
    # The open candidate: its number, where its unread rest starts, where it ends; and the last base span's end.
    state = {"number": F.lit(-1), "at": zero, "end": zero, "covered": zero}

    def cut(s: Column, upto: Column) -> Column:
        """The open candidate from its rest to `upto`, if that is long enough."""
        stop = F.least(upto, s["end"])
        return F.when(stop - s["at"] >= MIN_CANDIDATE, F.array(F.struct(s["number"].alias("number"), s["at"].alias("a"), stop.alias("b")))).otherwise(_none(kind))

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        own = x["number"] >= 0
        fields = {
            "number": F.when(own, x["number"]).otherwise(s["number"]),
            "at": F.when(own, F.greatest(x["start"], s["covered"])).otherwise(F.greatest(s["at"], x["end"])),
            "end": F.when(own, x["end"]).otherwise(s["end"]),
            "covered": F.when(own, s["covered"]).otherwise(F.greatest(s["covered"], x["end"])),
        }
        return fields, cut(s, x["start"])

    kind = "struct<number:int,a:bigint,b:bigint>"

    def left(found: Column) -> Column:
        ours = F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), i.alias("number"), x["end"].alias("end")))
        theirs = F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(-1).alias("number"), x["end"].alias("end")))
        pieces = _folded(F.sort_array(F.concat(ours, theirs)), state, step, kind, lambda s: cut(s, s["end"]))

        # Candidates are ASCII, so their characters are bytes, and a part is taken without reading what is before it.
        def named(starts: Column, data: Column) -> Column:
            def part(p: Column) -> Column:
                value = F.substring(F.get(data, p["number"]), (p["a"] - F.get(starts, p["number"]) + 1).cast("int"), (p["b"] - p["a"]).cast("int"))
                return F.struct(p["a"].alias("start"), value.cast("string").alias("m"))

            return F.transform(pieces, part)

        return _let(F.transform(found, lambda x: x["start"]), lambda starts: _let(F.transform(found, lambda x: F.to_binary(x["m"], F.lit("utf-8"))), lambda data: named(starts, data)))

    return _let(candidates, left)


def _entropy_spans(text: Column, base: Column) -> Column:
    def judged(x: Column) -> Column:
        span = lambda r: F.struct((x["start"] + r["first"] - 1).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (x["start"] + r["last"] - 1 + WINDOW).alias("end"))
        return _let(_hot_range(x["m"]), lambda r: F.when(r["first"] > 0, span(r)))

    worth = F.filter(_parts(_matches(text, CANDIDATE), base), lambda x: _candidate(x["m"]))
    found = F.filter(F.transform(worth, judged), lambda x: x.isNotNull())
    return F.when(F.rlike(text, F.lit(CANDIDATE)), found).otherwise(_none(SPAN))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `base_spans` and `all_spans`: arrays of start, kind (index in KINDS), end, in that order."""
    text = text_of(text_col)
    kinds = [
        _spans(text, ASSIGN, 0, lambda v: F.length(v) >= MIN_ASSIGNED),
        _spans(text, ACCESS, 1, lambda v: F.lit(True)),
        _spans(text, HEX, 2, lambda v: F.lit(True)),
    ]
    step = docs.withColumn("base_spans", F.sort_array(F.concat(*kinds)))
    return step.withColumn("all_spans", F.sort_array(F.concat("base_spans", _entropy_spans(text, F.col("base_spans")))))


def spans_text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or union of overlapping spans, replaced by the mark; `spans` are in order."""
    kind = "struct<a:bigint,b:bigint>"
    state = {"at": F.lit(0).cast("long")}

    def gap(a: Column, b: Column) -> Column:
        return F.array(F.struct(a.alias("a"), b.alias("b")))

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        overlaps = (x["start"] < s["at"]) & (s["at"] > 0)
        return {"at": F.greatest(s["at"], x["end"])}, F.when(overlaps, _none(kind)).otherwise(gap(s["at"], x["start"]))

    def cut(chunks: Column, size: Column, spans: Column) -> Column:
        gaps = _folded(spans, state, step, kind, lambda s: gap(s["at"], size))

        def part(g: Column) -> Column:
            i, j = (F.floor(g[e] / TEXT_CHUNK).cast("int") for e in "ab")
            low, high = (F.pmod(g[e], F.lit(TEXT_CHUNK)).cast("int") for e in "ab")
            first, last = F.get(chunks, i), F.coalesce(F.get(chunks, j), F.lit(""))
            within = F.substring(first, low + 1, high - low)
            across = F.concat(F.substring(first, low + 1, F.lit(TEXT_CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), high))
            return F.when(g["a"] >= g["b"], "").when(i == j, within).otherwise(across)

        return F.array_join(F.transform(gaps, part), mark)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_CHUNK}}}"), F.lit(0))
    whole = _let(chunks, lambda c: _let(spans, lambda x: cut(c, F.length(text).cast("long"), x)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text("base_spans").cast("binary"), 256).alias("base_sha256"),
        spans_text("all_spans").alias("spans"),
    )
