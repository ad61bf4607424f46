"""Notes with their texts, and references and anchors with what they point to.

Nulls: a line without text is empty; rows without a key or a place are left out.
Equal rows count as they stand. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped
from . import markers, patterns

#: One or two notes may be missing from a count without doubt.
SMALL_GAP = 3
#: Against the body's size: what is small print, what is still body, what is larger.
SMALL, BODY, LARGER = 0.92, 1.05, 1.15


def line_marker(text: Column, lead: Column | None = None) -> Column:
    """What a note's line begins with: struct<n, raw, rest, sup>; null where nothing does. lead: the text that is set superscript at its beginning, if any."""
    lead = F.lit(None).cast("string") if lead is None else lead
    text = F.coalesce(text, F.lit(""))
    bare = F.replace(lead, F.lit(" "), F.lit(""))
    value = F.when(F.length(lead).between(1, 7), markers.marker_value(bare))
    number, letter = (F.regexp_extract(text, p, 1) for p in (patterns.NOTE_START, patterns.LETTER_NOTE_START))
    found = lambda n, raw, rest, sup: F.struct(n.cast("int").alias("n"), raw.alias("raw"), rest.alias("rest"), F.lit(sup).alias("sup"))
    return (
        F.when(value.isNotNull(), found(value, bare, F.substring(text, F.length(lead) + 1, F.length(text)), True))
        .when(number != "", found(number, number, F.regexp_replace(text, patterns.NOTE_START, ""), False))
        .when(letter != "", found(F.ascii(letter) - 96 + markers.LETTERS_FROM, letter, F.regexp_replace(text, patterns.LETTER_NOTE_START, ""), False))
    )


def believed(n: int, last: int | None, last_page, page, follows: int | None) -> bool:
    """Whether n is the next note: numbers rise, but begin again on a new page; a jump is believed unless the count then goes on as if it had not been."""
    if last is None:
        return True
    if n <= last:
        return page != last_page
    return n <= last + SMALL_GAP or follows is None or not last < follows <= last + SMALL_GAP


def sequenced(frags: list[tuple]) -> tuple[list[tuple], list[tuple[int | None, str]]]:
    """Notes (n, marker, page, how) and, for each fragment, its note's place among them and its part in it ('head', 'text', 'refused').

    frags: (page, block, n, raw, solid) in reading order; n and raw null where the
    line begins with no marker; solid: it has more than points and brackets. Lines
    before a block's first marker wait: if just the number before that marker is
    missing they are that note (how 'inferred'), else they go on with the note
    before. A marker that isn't believed goes on with the note it stands in; where
    it differs in one digit from the number that is then missing, it was that
    number (how 'misread').
    """
    follows: list[int | None] = [None] * len(frags)
    after = None
    for k in range(len(frags) - 1, -1, -1):
        follows[k] = after
        after = after if frags[k][2] is None else frags[k][2]
    notes: list[list] = []
    own: list[list] = [[None, "text"] for _ in frags]
    refused: dict[int, list[int]] = {}
    waiting: list[int] = []
    last = last_page = block = None
    current: int | None = None
    marked = False

    def go_on(held: list[int]) -> None:
        for w in held:
            own[w][0] = current
        held.clear()

    for k, (page, of, n, raw, _) in enumerate(frags):
        if not k or of != block:
            go_on(waiting)
            block, marked = of, False
        if n is None:
            if marked:
                own[k][0] = current
            else:
                waiting.append(k)
            continue
        marked = True
        if believed(n, last, last_page, page, follows[k]):
            if waiting and (last == n - 2 if last is not None else n == 2):
                notes.append([n - 1, str(n - 1), frags[waiting[0]][0], "inferred"])
                current = len(notes) - 1
                own[waiting[0]][1] = "head"
            go_on(waiting)
            notes.append([n, raw, page, "read"])
            current, last, last_page = len(notes) - 1, n, page
            own[k] = [current, "head"]
        else:
            go_on(waiting)
            own[k] = [current, "refused"]
            if current is not None:
                refused.setdefault(current, []).append(k)
    go_on(waiting)
    held: dict[int, int] = {}
    for note in notes:
        held[note[0]] = held.get(note[0], 0) + 1
    where = list(range(len(notes)))  # each note's place in document order; a recovered one comes behind the note it was part of
    for at in range(len(notes)):
        want = notes[at][0] + 1
        if len(refused.get(at, ())) != 1 or held.get(want):
            continue
        k = refused[at][0]
        raw = frags[k][3]
        if not raw.isdigit() or len(raw) != len(str(want)) or sum(a != b for a, b in zip(raw, str(want))) != 1:
            continue
        rest = [j for j in range(k, len(frags)) if own[j][0] == at]
        if not any(frags[j][4] for j in rest):
            continue
        notes.append([want, str(want), frags[k][0], "misread"])
        where.append(at)
        held[want] = 1
        for j in rest:
            own[j][0] = len(notes) - 1
        own[k][1] = "head"
    order = sorted(range(len(notes)), key=lambda x: (notes[x][2], notes[x][0], where[x], x))
    place = {old: new for new, old in enumerate(order)}
    return [tuple(notes[x]) for x in order], [(place.get(o), part) for o, part in own]


def note_records(lines: DataFrame, key: str, order: str, page: str, block: str, text: str, lead: str | None = None) -> DataFrame:
    """One row per note: key, note (place, from 0), n, marker, page, how, n_lines, text.

    lines: the lines of the blocks that hold notes; equal places in order of their
    text. Text is shuffled once, and a document's lines are what a task holds.
    """
    marked = lines.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("_m", line_marker(F.col(text), None if lead is None else F.col(lead)))
    rest = F.coalesce("_m.rest", text, F.lit(""))
    rows = marked.select(key, order, F.coalesce(F.col(page), F.lit(0)).alias("_page"), F.col(block).alias("_block"), F.col("_m.n").alias("_n"), F.col("_m.raw").alias("_raw"), rest.alias("_rest"))
    kinds = [("note", T.IntegerType()), ("n", T.IntegerType()), ("marker", T.StringType()), ("page", rows.schema["_page"].dataType), ("how", T.StringType()), ("n_lines", T.LongType()), ("text", T.StringType())]
    schema = T.StructType([rows.schema[key], *[T.StructField(*k) for k in kinds]])

    def work(group: list[tuple]) -> list[tuple]:
        found, own = sequenced([(*g[2:6], g[6].strip(".) \t\r\n") != "") for g in group])
        pieces: list[list[str]] = [[] for _ in found]
        for g, (at, part) in zip(group, own):
            if at is not None:
                pieces[at].append(f"{g[5]} {g[6]}" if part == "refused" else g[6])
        said = (" ".join(p) for p in pieces)
        return [(group[0][0], at, *n, len(pieces[at]), (t if n[3] == "inferred" else t.lstrip(".) ")).strip()) for at, (n, t) in enumerate(zip(found, said))]

    return grouped(rows, [key], [order, "_rest"], work, schema)


def counted(block: tuple, expected: int | None) -> tuple[int, int | None]:
    """How many of a block's markers count on from `expected` (or from anywhere), and the number expected then."""
    n = 0
    for m in block[2]:
        if m is not None and (expected is None or m in (expected, expected + 1)):
            n, expected = n + 1, m + 1
    return n, expected


def cited_runs(blocks: list[tuple]) -> set[int]:
    """Blocks of runs whose leading markers count straight on (three blocks at most between them) and that cite at least half as often as they count: four notes in print of the body's size, two in small print."""
    chosen: set[int] = set()
    fits = [b[2][:1] != [] and b[2][0] is not None and b[0] <= BODY * b[1] for b in blocks]
    k = 0
    while k < len(blocks):
        if not fits[k]:
            k += 1
            continue
        n, expected = counted(blocks[k], None)
        chain, missed, j = [k], 0, k + 1
        while j < len(blocks) and missed <= 3:
            if fits[j] and blocks[j][2][0] in (expected, expected + 1):
                more, expected = counted(blocks[j], expected)
                n, missed = n + more, 0
                chain.append(j)
            else:
                missed += 1
            j += 1
        small = all(blocks[c][0] <= SMALL * blocks[c][1] for c in chain)
        if n >= (2 if small else 4) and sum(blocks[c][4] for c in chain) >= 0.5 * n:
            chosen.update(chain)
        k = max(j, k + 1)
    return chosen


def with_notes(blocks: list[tuple]) -> list[bool]:
    """Which blocks hold notes. blocks: (size, body, markers of the lines, first is superscript, citations, heading of notes, length, begins in lower case, at the page's foot)."""
    runs, out, inside, found = cited_runs(blocks), [], False, False
    for k, (size, body, marks, sup, cites, heading, length, lower, foot) in enumerate(blocks):
        first = bool(marks) and marks[0] is not None
        take = False
        if heading:
            inside = True
            out.append(False)
            continue
        if not inside:
            take = k in runs
        elif size > LARGER * body:
            inside = False
        elif first or (found and (length <= 4 or (size < LARGER * body and (lower or any(m is not None for m in marks))))):
            take = True
        else:
            inside = False
        if not take and not inside and size <= SMALL * body:
            take = (foot or sup or cites > 0) if first else (sum(m is not None for m in marks[1:]) >= 2 and cites > 0)
        found |= take
        out.append(take)
    return out


def note_blocks(blocks: DataFrame, key: str, order: str, lines: str = "lines", text: str = "text", size: str = "size", body: str = "body", foot: str = "foot", lead: str | None = None) -> DataFrame:
    """key, order of the blocks that hold notes: those under a heading of notes, small numbered print at a page's foot or with citations, and runs that count on and cite.

    lines: array of the block's lines; size, body: of its print and of the document's body; foot: whether it stands at its page's foot. lead: superscript text at the first line's beginning.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    plain = F.regexp_replace(said, r"^\s+|\s+$", "")
    every = F.transform(F.coalesce(F.col(lines), F.array().cast("array<string>")), lambda x: line_marker(x)["n"])
    first = line_marker(F.get(F.col(lines), F.lit(0)), F.col(lead)) if lead else None
    marks = F.concat(F.array(first["n"]), F.slice(every, 2, F.size(every))) if lead else every
    sup = F.coalesce(first["sup"], F.lit(False)) if lead else F.lit(False)
    rows = blocks.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(
        key, order, F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("_size"), F.coalesce(F.col(body).cast("double"), F.lit(0.0)).alias("_body"), marks.alias("_marks"), sup.alias("_sup"),
        F.size(F.regexp_extract_all(said, F.lit(patterns.CITATION), 1)).alias("_cites"), plain.rlike(patterns.NOTES_HEADING).alias("_heading"), F.length(plain).alias("_length"), said.rlike(r"^\p{Ll}").alias("_lower"), F.coalesce(F.col(foot), F.lit(False)).alias("_foot"),
    )
    schema = T.StructType(rows.schema.fields[:2])
    return grouped(rows, [key], [order, "_marks"], lambda g: [r[:2] for r, take in zip(g, with_notes([x[2:] for x in g])) if take], schema)


def note_keys(notes: DataFrame, key: str, page: str = "page", n: str = "n") -> DataFrame:
    """key, n, page, target: a note's number where it is the only one, else page-number. Notes that stand twice on a page count once."""
    distinct = notes.where(F.col(n).isNotNull()).select(key, F.col(n).alias("n"), F.col(page).alias("page")).distinct()
    copies = F.count(F.lit(1)).over(Window.partitionBy(key, "n"))
    name = F.when(copies == 1, F.col("n").cast("string")).otherwise(F.concat_ws("-", F.coalesce(F.col("page").cast("string"), F.lit("")), F.col("n").cast("string")))
    return distinct.withColumn("target", name)


def resolved_references(refs: DataFrame, notes: DataFrame, key: str, ref: str, n: str = "n", page: str = "page") -> DataFrame:
    """refs (key, ref, n, page) with target, target_page and reason ('only', 'same page', 'nearest', 'first', or 'no note').

    The note of a number: the only one; else that of the reference's page; else the
    nearest page, of two the lower; where a reference has no page, the first. Notes
    and references of a number are merged in one order of pages, so a number that
    begins again on every page is no product of both.
    """
    offers = note_keys(notes, key).select(key, "n", F.coalesce(F.col("page"), F.lit(0)).cast("long").alias("_at"), "target")
    counts = offers.groupBy(key, "n").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_at", "target")).alias("_first"))
    asked = refs.select(key, F.col(ref).alias("ref"), F.col(n).alias("n"), F.col(page).cast("long").alias("page"))
    known = asked.join(counts, [key, "n"], "left")
    single = F.col("_n").isNull() | (F.col("_n") == 1) | F.col("page").isNull()
    why = F.when(F.col("_n").isNull(), "no note").when(F.col("_n") == 1, "only").otherwise("first")
    plain = known.where(single).select(key, "ref", "n", "page", F.col("_first.target").alias("target"), F.col("_first._at").alias("target_page"), why.alias("reason"))
    many = known.where(~single).select(key, "n", F.col("page").alias("_at"), "ref", F.lit(None).cast("string").alias("target"))
    listed = offers.join(counts.where("_n > 1").select(key, "n"), [key, "n"]).select(key, "n", "_at", F.lit(None).cast(asked.schema["ref"].dataType).alias("ref"), "target")
    both = many.withColumn("_note", F.lit(False)).unionByName(listed.withColumn("_note", F.lit(True)))
    along = Window.partitionBy(key, "n").orderBy("_at")
    note = F.when(F.col("_note"), F.struct("_at", "target"))
    sides = both.withColumns({"_back": F.last(note, ignorenulls=True).over(along.rangeBetween(Window.unboundedPreceding, 0)), "_ahead": F.first(note, ignorenulls=True).over(along.rangeBetween(0, Window.unboundedFollowing))}).where("NOT _note")
    back = F.col("_ahead").isNull() | (F.col("_at") - F.col("_back._at") <= F.col("_ahead._at") - F.col("_at"))
    best = F.when(F.col("_back").isNotNull() & back, F.col("_back")).otherwise(F.col("_ahead"))
    near = sides.withColumn("_best", best).select(key, "ref", "n", F.col("_at").alias("page"), F.col("_best.target").alias("target"), F.col("_best._at").alias("target_page"), F.when(F.col("_best._at") == F.col("_at"), "same page").otherwise("nearest").alias("reason"))
    return plain.unionByName(near)


def back_references(resolved: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Every note with how many references it has and the first: key, target, n, page, n_refs, first_ref; 0 and null where none points to it."""
    found = resolved.where(F.col("target").isNotNull()).groupBy(key, "target").agg(F.count(F.lit(1)).alias("n_refs"), F.min("ref").alias("first_ref"))
    return note_keys(notes, key).join(found, [key, "target"], "left").select(key, "target", "n", "page", F.coalesce("n_refs", F.lit(0).cast("long")).alias("n_refs"), "first_ref")


def anchor_key(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def resolved_anchors(anchors: DataFrame, targets: DataFrame, key: str, anchor: str, text: str, target: str, title: str, least: int = 8) -> DataFrame:
    """anchors (key, anchor) with target and reason: 'exact', 'prefix', or null with 'short', 'unknown', 'several'.

    An anchor's text is a title, or one of both begins with the other, for one
    target alone. Titles of one text count as the last of them (by target). Prefixes
    are found over the first `least` characters, and over the beginnings of the
    anchor's text for shorter titles; no anchor meets all titles.
    """
    held = targets.select(key, anchor_key(F.col(title)).alias("_t"), F.col(target).alias("_to")).where("_t <> ''").groupBy(key, "_t").agg(F.max("_to").alias("_to"))
    said = anchor_key(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[,.;:]+\s*$", ""))
    asked = anchors.select(key, F.col(anchor).alias("anchor"), said.alias("_a"))
    head = F.when(F.length("_t") < least, F.col("_t")).otherwise(F.substring("_t", 1, least))
    ends = F.transform(F.sequence(F.lit(1), F.lit(least)), lambda k: F.substring(F.col("_a"), F.lit(1), k))
    usable = asked.where(F.length("_a") >= least).select(key, "_a").distinct()
    offers = usable.select(key, "_a", F.explode(ends).alias("_h")).join(held.withColumn("_h", head), [key, "_h"]).where(F.startswith("_a", "_t") | F.startswith("_t", "_a"))
    best = offers.groupBy(key, "_a").agg(F.max(F.when(F.col("_a") == F.col("_t"), F.col("_to"))).alias("_same"), F.count(F.lit(1)).alias("_n"), F.max("_to").alias("_one"))
    why = F.when(F.length("_a") < least, "short").when(F.col("_same").isNotNull(), "exact").when(F.col("_n").isNull(), "unknown").when(F.col("_n") == 1, "prefix").otherwise("several")
    return asked.join(best, [key, "_a"], "left").select(key, "anchor", F.coalesce("_same", F.when(F.col("_n") == 1, F.col("_one"))).alias("target"), why.alias("reason"))
