"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Only DataFrame functions are used, in one narrow pass. A candidate is a run of at least ``WINDOW``
characters of ``[A-Za-z0-9+/_=-]`` that holds a digit and a letter. Its class (the smallest alphabet that
holds it without a known prefix: hexadecimal, base32, letters of one case, or mixed) sets the threshold, but a window
of hexadecimal digits has theirs, whatever is around it. A window slides over it: the
counts of its characters, packed as five bits each into six integers, and the sum of ``c * log2(c)`` over them
change only by the character that enters and the one that leaves. A candidate
with a window at or above its class's threshold is a span of kind ``entropy``, unless it matches the
allow list or overlaps a span of a fixed pattern.

Positions count code points; ends are exclusive. Null texts are empty; empty texts have no spans;
repeated rows get repeated results; texts are scanned whole; other columns are kept or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, with pattern and the least length of the group that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the runs AKIA[A-Z0-9]+ of 16 or more characters
HEX = r"[0-9a-f]{32,}"  # the runs [0-9a-f]+ of 32 or more characters
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"  # a whole run, with a digit
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least bits per character within a window (at most log2(20) = 4.32): what 99 % of random strings of 20
#: characters reach of 16, 32, 36 and 62 symbols (by 40,000 simulated ones each); longer ones reach it more often.
HEX_BITS, BASE32_BITS, CASE_BITS, MIXED_BITS = 2.88, 3.34, 3.40, 3.64
#: What keys of well-known services begin with; it says nothing of the rest's alphabet.
PREFIX = r"^(gh[opsur]_|github_pat_|glpat-|[spr]k[-_](live|test|proj)[-_]|sk-|xox[abprs]-|npm_|pypi-|hf_|shpat_|AIza)"
#: Matches that are laid end to end at a time.
CHUNK = 256
#: What candidates are made of; with counts of five bits each, twelve to an integer.
ALPHABET, PACK, WIDTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 12, 5
#: Candidates that match as a whole are never secrets: UUIDs, words, numbers and short
#: marks (2nd, v2) joined by single separators, examples.
ALLOW = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^([A-Z]?[a-z]+|[A-Z]+|[0-9]+|[0-9]{1,3}[a-z]{1,2}|[A-Za-z]{1,2}[0-9]{1,3})([-_/=+]([A-Z]?[a-z]+|[A-Z]+|[0-9]+|[0-9]{1,3}[a-z]{1,2}|[A-Za-z]{1,2}[0-9]{1,3}))*$",
    r"(?i)^((example|placeholder|dummy|sample|your|my|api|access|secret|password|token|key)[-_]?)+[0-9x]*$",
)


def located(text: Column, pattern: str, kind: int, needs: Column, keep: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start, kind, end, text>>``: the pieces between
    the matches and the matches themselves, laid end to end, give the places."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    extra = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep is not None else found
    parts = F.zip_with(F.slice(pieces, 1, F.size(found)), F.arrays_zip(found.alias("f"), extra.alias("g")), lambda p, m: F.struct(F.length(p).alias("gap"), m["f"].alias("f"), m["g"].alias("g")))
    spans = "array<struct<start:int,kind:int,end:int,text:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + F.length(m["f"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["f"].alias("text"))
        whole = F.concat(acc["out"], F.array(span))
        return F.struct(end.alias("at"), (whole if keep is None else F.when(F.length(m["g"]) >= keep, whole).otherwise(acc["out"])).alias("out"))

    def chunked(p: Column) -> Column:
        """Appending copies what is there, so spans are made within chunks, and chunks laid end to end."""
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda k: F.aggregate(F.slice(p, k * CHUNK + 1, F.lit(CHUNK)), zero, step))
        moved = lambda c, by: F.transform(c["out"], lambda x: F.struct((x["start"] + by).alias("start"), x["kind"].alias("kind"), (x["end"] + by).alias("end"), x["text"].alias("text")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("out"))
        return F.flatten(F.aggregate(chunks, start, lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["out"], F.array(moved(c, a["at"]))).alias("out")))["out"])

    # As a lambda's variable the parts are worked out once.
    return F.when(needs & text.rlike(pattern), F.element_at(F.transform(F.array(parts), chunked), 1)).otherwise(F.array().cast(spans))


def peak_entropy(candidate: Column, window: int = WINDOW, least: Column | None = None, hex_least: float = 0.0) -> Column:
    """The highest Shannon entropy, in bits per character, of any window (of at most 31 characters) of the candidate;
    with ``least``, by how much it is above that, or above ``hex_least`` in a window of hexadecimal digits."""
    one = F.lit(1).cast("bigint")
    places = F.transform(F.split(candidate, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    shifted = lambda name, x, n: F.call_function(name, x, n)

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def count(counts: Column, at: Column) -> Column:
        return shifted("shiftright", F.get(counts, (at / PACK).cast("int")), at % PACK * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))

    def hexadecimal(at: Column) -> Column:
        return at.between(0, 5) | at.between(26, 31) | at.between(52, 61)

    def peak(ix: Column) -> Column:
        zero = F.array_repeat(F.lit(0).cast("bigint"), -(-len(ALPHABET) // PACK))
        start = F.struct(zero.alias("counts"), F.lit(0.0).alias("s"), F.lit(-10.0).alias("best"), F.lit(-1).alias("other"))

        def bits(a: Column, at: Column) -> Column:
            """Of the window that ends at ``at``; ``other`` is the last place of what is no hexadecimal digit."""
            found = F.log2(F.lit(float(window))) - a["s"] / window
            return found if least is None else found - F.when(a["other"] <= at - window, hex_least).otherwise(least)

        def step(a: Column, i: Column) -> Column:
            enters, leaves = F.get(ix, i), F.when(i >= window, F.get(ix, i - window))
            add, drop = shifted("shiftleft", one, enters % PACK * WIDTH), shifted("shiftleft", one, leaves % PACK * WIDTH)
            counts = F.transform(a["counts"], lambda c, j: c + F.when(j == (enters / PACK).cast("int"), add).otherwise(0) - F.when(j == (leaves / PACK).cast("int"), drop).otherwise(0))
            c_in, c_out = count(a["counts"], enters), count(a["counts"], leaves)
            change = F.when(enters == leaves, 0.0).otherwise(weight(c_in + 1) - weight(c_in) + F.when(leaves.isNotNull(), weight(c_out - 1) - weight(c_out)).otherwise(0.0))
            return F.struct(counts.alias("counts"), (a["s"] + change).alias("s"), F.when(i >= window, F.greatest(a["best"], bits(a, i - 1))).otherwise(a["best"]).alias("best"), F.when(hexadecimal(enters), a["other"]).otherwise(i).alias("other"))

        return F.aggregate(F.sequence(F.lit(0), F.size(ix) - 1), start, step, lambda a: F.greatest(a["best"], bits(a, F.size(ix) - 1)))

    return F.element_at(F.transform(F.array(places), peak), 1)


def suspicious(c: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | c.rlike(pattern)
    bare = F.regexp_replace(c, PREFIX, "")
    bare = F.when(F.length(bare) >= WINDOW, bare).otherwise(c)
    least = whole_class(bare)
    # When-branches are lazy: only what is left pays for the entropy.
    return F.when(~(c.rlike("[0-9]") & c.rlike("[A-Za-z]")) | allowed, F.lit(False)).otherwise(peak_entropy(bare, WINDOW, least, HEX_BITS) >= 0)


def whole_class(c: Column) -> Column:
    """The least entropy of the smallest alphabet that holds the candidate."""
    return F.when(c.rlike("^[0-9A-Fa-f]+$"), HEX_BITS).when(c.rlike("^([A-Z2-7]+|[a-z2-7]+)=*$"), BASE32_BITS).when(~(c.rlike("[A-Z]") & c.rlike("[a-z]")), CASE_BITS).otherwise(MIXED_BITS)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``found`` (base and entropy spans), each sorted by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(located(text, ASSIGN, 0, text.contains(":") | text.contains("="), F.lit(8)), located(text, ACCESS, 1, text.contains("AKIA")), located(text, HEX, 2, F.lit(True))))
    docs = docs.withColumns({"base": base, "candidates": F.filter(located(text, CANDIDATE, 3, F.lit(True)), lambda s: suspicious(s["text"]))})
    apart = F.filter("candidates", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return docs.withColumn("found", F.array_sort(F.concat("base", apart))).drop("candidates")


def joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """Per document row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return with_spans(docs.select("doc_id", "text")).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one); null texts stay null."""
    names = docs.columns
    found = with_spans(docs.select(F.struct(*names).alias("row"), "text"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(a: Column, s: Column) -> Column:
        piece = F.when(s["start"] < a["at"], "").otherwise(F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    clean = F.aggregate("found", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.size("found") > 0, clean).otherwise(text)
    out = found.withColumn("clean", clean)
    return out.select(*[F.col("clean").alias(n) if n == "text" else F.length("clean").cast("bigint").alias(n) if n == "n_chars" else F.col(f"row.{n}").alias(n) for n in names])
