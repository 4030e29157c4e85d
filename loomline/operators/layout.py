"""Reading order of PDF pages (E6): text runs with their places become the text of each page."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import chunking
from loomline.operators.graph import cut

# Fixed values, which must equal those of the archives' pages: bounds of a page (runs, UTF-16 units); the share of a
# run's size by which runs of a line may differ in height; gaps, in sizes, that a blank, a tab and a new block take;
# the ratio of sizes that parts blocks; the slope that counts as rotated; indent in sizes a blank, and the most
# blanks; probes for a gutter, units on each side of it and sizes of its gap and margin, lines it needs.
PAGE_RUNS, PAGE_UNITS = 10_000, 262_144
SAME_LINE, BLANK_GAP, TAB_GAP, BLOCK_GAP, SIZE_RATIO, SLOPE = 0.25, 0.18, 2, 2.1, 1.25, 0.01
INDENT, MOST_INDENT = 0.6, 32
PROBES, SIDE_UNITS, GUTTER_GAP, GUTTER_MARGIN, GUTTER_LINES = 64, 16, 2, 1, 3

PAGE = ["document", "page"]
RESULT = "outcome string, mode string, reasons array<string>, columns int, text string, runs array<int>"
ARROW = {"outcome": pa.string(), "mode": pa.string(), "reasons": pa.list_(pa.string()), "columns": pa.int32(), "text": pa.string(), "runs": pa.list_(pa.int32())}
#: Largest number of pages beyond the bounds that is broadcast.
BROADCAST_PAGES = 200_000


def bare(text: str) -> str:
    """The text without white space around it, in the archives' sense of white space."""
    a = chunking.leading_blank(text)
    return text[a : chunking.trailing_blank(text)] if a < len(text) else ""


def line_numbers(page: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which line each run is on; runs come page by page from the top down, and a line stays at the height of its first run."""
    lines, line, last, top, tall = [], -1, None, 0.0, 0.0
    for own, at, s in zip(page.tolist(), y.tolist(), size.tolist()):
        if own == last and abs(top - at) <= min(tall, s) * SAME_LINE:
            tall = max(tall, s)
        else:
            line, last, top, tall = line + 1, own, at, s
        lines.append(line)
    return np.array(lines, int)


def fresh(*keys: np.ndarray) -> np.ndarray:
    """Where a run differs from the one before in some key; the first one does."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def gutters(page: np.ndarray, x: np.ndarray, end: np.ndarray, prose: np.ndarray, tall: np.ndarray, first: np.ndarray) -> dict[int, float]:
    """By page the x between two columns of prose: where most lines (three at least) have a wide gap; of equals the most central.

    ``first`` marks the first run of each line, ``prose`` counts the units of a run, ``tall`` is the size of its line.
    """
    at, line = np.flatnonzero(first), np.cumsum(first) - 1
    upto = np.cumsum(prose)
    upto, total = upto - (upto[at] - prose[at])[line], np.add.reduceat(prose, at)[line]
    start = np.where(np.append(first[1:], True), np.nan, np.append(x[1:], np.nan))  # of the next run on the line
    wide = (upto >= SIDE_UNITS) & (total - upto >= SIDE_UNITS) & (start - end >= tall * GUTTER_GAP)
    probes, found = np.arange(1, PROBES - 1), {}
    for own in np.flatnonzero(np.bincount(page[wide]) >= GUTTER_LINES).tolist():
        a, b = np.searchsorted(page, [own, own + 1])
        low, high = x[a:b].min(), end[a:b].max()
        if high <= low:
            continue
        left, right, margin = (v[a:b][wide[a:b]][:, None] for v in (end, start, tall * GUTTER_MARGIN))
        places = low + (high - low) * probes / PROBES
        votes = ((places > left + margin) & (places < right - margin)).sum(axis=0)
        best = np.lexsort((np.abs(probes - PROBES // 2), -votes))[0]
        if votes[best] >= GUTTER_LINES:
            found[own] = places[best]
    return found


def in_columns(page: np.ndarray, x: np.ndarray, end: np.ndarray, first: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band, side) of each run: bands are read in turn, each side by side; a line across the gutter is a band of its own.

    ``middle`` is the gutter of the run's page, not a number without one.
    """
    line, at = np.cumsum(first) - 1, np.flatnonzero(first)
    across = np.logical_or.reduceat((x < middle) & (end > middle), at)
    band = np.cumsum(across | (np.append(False, across[:-1]) & ~fresh(page[at])))
    return band[line], np.where(across[line], 0, x >= middle)


def geometric(page: np.ndarray, texts: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, width: np.ndarray, mono: np.ndarray, prose: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """(run, white space before it, gutters by page) of the runs of many pages in reading order; each page's own text ends with a line feed.

    No text is empty; ``page`` ascends, ``prose`` counts a run's units, ``blank`` tells in two columns whether it starts and ends with white space.
    """
    run = np.lexsort((np.arange(len(page)), x, -y, page))
    line = line_numbers(page[run], y[run], size[run])
    order = np.lexsort((run, x[run], line))
    run, line = run[order], line[order]
    first, end = fresh(line), x + np.abs(width)
    at = np.flatnonzero(first)
    tall, top = np.maximum.reduceat(size[run], at)[line], np.maximum.reduceat(y[run], at)[line]
    middles = gutters(page[run], x[run], end[run], prose[run], tall, first)
    middle = np.full(page.max() + 1, np.nan)
    middle[list(middles)] = list(middles.values())
    band, side = in_columns(page[run], x[run], end[run], first, middle[page[run]])
    order = np.lexsort((np.arange(len(run)), side, band, page[run]))
    run, line, band, side, tall, top = (v[order] for v in (run, line, band, side, tall, top))

    opens = fresh(band, side, line)
    at = np.flatnonzero(opens)  # from here on one value a line
    start, own, all_mono = x[run][at], size[run][at], np.logical_and.reduceat(mono[run], at)
    band, side, line_tall, top, line_page = (v[at] for v in (band, side, tall, top, page[run]))
    starts = fresh(line_page)
    parted = fresh(band, side, all_mono) | starts
    small, large = np.minimum(line_tall[1:], line_tall[:-1]), np.maximum(line_tall[1:], line_tall[:-1])
    parted[1:] |= (top[:-1] - top[1:] > large * BLOCK_GAP) | (large > small * SIZE_RATIO)
    left = np.minimum.reduceat(start, np.flatnonzero(parted))[np.cumsum(parted) - 1]
    indent = np.where(all_mono, np.clip(np.floor((start - left) / (own * INDENT) + 0.5), 0, MOST_INDENT), 0).astype(int)
    gap = np.append(0.0, x[run[1:]] - end[run[:-1]])
    apart = (gap > tall * BLANK_GAP) & ~np.append(False, blank[run[:-1], 1]) & ~blank[run, 0]
    space = np.array(["", " ", "\t"], object)[np.where(gap > tall * TAB_GAP, 2, apart)]
    space[at] = np.array(["", "\n", "\n\n"], object)[np.where(starts, 0, 1 + parted)]
    deep = np.flatnonzero(indent)
    space[at[deep]] += np.array([" " * i for i in range(MOST_INDENT + 1)], object)[indent[deep]]
    return run, space, middles


def page_texts(table: pa.Table) -> pa.RecordBatch:
    """A row of PAGE and RESULT for each page of a table of whole pages, their runs by ascending index."""
    col = lambda c: table.column(c).to_numpy()
    keys = table.select(PAGE).combine_chunks()
    new = _edges(keys)
    page, at = np.cumsum(new) - 1, np.flatnonzero(new)
    ends, n = np.append(at[1:], len(page)), len(at)
    words = table.column("str").combine_chunks().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    code, names = words.indices.to_numpy(), words.dictionary.to_pylist()
    prose = np.array([len(chunking.units(bare(w))) for w in names], int)[code]
    blank = np.array([(chunking.leading_blank(w) > 0, chunking.trailing_blank(w) < len(w)) for w in names], bool)[code]
    texts = np.array([*names, None], object)[code]
    t = table.column("transform").combine_chunks().flatten().to_numpy().reshape(-1, 6)
    size = np.maximum.reduce([np.full(len(t), 0.001), np.hypot(t[:, 2], t[:, 3]), np.abs(col("height"))])
    turned = (t[:, 0] <= 0) | (t[:, 3] <= 0) | (np.abs(t[:, 1:3]) > size[:, None] * SLOPE).any(axis=1)
    seen, index, eol = prose > 0, col("item_index"), col("has_eol")
    checks = {"non_ltr": ~col("ltr"), "rotated_or_skewed": turned}
    faults = {reason: np.logical_or.reduceat(seen & holds, at) for reason, holds in checks.items()}
    sound, kept = np.logical_and.reduceat(col("sound"), at), np.logical_or.reduce(list(faults.values()))
    own = np.flatnonzero((sound & ~kept)[page] & (texts != ""))
    middles, out, order = {}, [""] * n, [[]] * n
    if len(own):
        run, space, middles = geometric(page[own], texts[own], t[own, 4], t[own, 5], size[own], col("width")[own], col("monospace")[own], prose[own], blank[own])
        run = own[run]
        pieces = np.stack([space, texts[run]], axis=1).ravel().tolist()
        edges = np.flatnonzero(fresh(page[run])).tolist()
        for a, b in zip(edges, [*edges[1:], len(run)]):
            out[page[run[a]]], order[page[run[a]]] = "".join(pieces[2 * a : 2 * b]) + "\n", index[run[a:b]]
    for p in np.flatnonzero(sound & kept).tolist():
        runs = range(at[p], ends[p])
        out[p] = "".join(texts[i] + "\n" * bool(eol[i]) for i in runs)
        order[p] = index[[i for i in runs if texts[i]]]
    fits = np.array([len(s) * 2 <= PAGE_UNITS or len(chunking.units(s)) <= PAGE_UNITS for s in out], bool)
    ok = sound & fits
    rows = {
        "outcome": np.where(ok, "ok", np.where(sound, "capacity", "parse_failed")).tolist(), "mode": ["source_order" if k else "geometric" for k in kept.tolist()], "reasons": [[r for r, f in faults.items() if f[p]] for p in range(n)],
        "columns": [2 if p in middles else 1 for p in range(n)], "text": out, "runs": order,
    }
    for c in list(rows)[1:]:
        rows[c] = [v if o else None for v, o in zip(rows[c], ok.tolist())]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (keys.column(c).take(pa.array(at)).combine_chunks() for c in PAGE)]
    return pa.RecordBatch.from_arrays(columns + [pa.array(rows[c], kind) for c, kind in ARROW.items()], names=PAGE + list(ARROW))


def _edges(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where a page starts; the first row does."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for c in PAGE:
        v = rows.column(c)
        a, b = v.slice(1), v.slice(0, len(v) - 1)
        for differ in (pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))):
            new[1:] |= differ.to_numpy() if isinstance(differ, pa.ChunkedArray) else differ.to_numpy(zero_copy_only=False)
    return new


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole pages of rows that are sorted by page; what a batch leaves open waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        start = int(np.flatnonzero(_edges(batch))[-1])
        if start or held and _edges(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1).select(PAGE), batch.slice(0, 1).select(PAGE)]))[1]:
            yield page_texts(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = []
        held.append(batch.slice(start))
    if held:
        yield page_texts(pa.Table.from_batches(held))


def pages(runs: DataFrame) -> DataFrame:
    """(document, page, outcome, mode, reasons, columns, text, runs) of every page.

    runs: document, page, item_index, str, transform (six numbers, the last two a place), width, height, dir, has_eol,
    monospace; other columns are ignored. ``outcome`` is ``ok``, ``parse_failed`` (a null text, a place that is not
    finite, an index outside the page) or ``capacity`` (too many runs or units, with or without the white space
    added), the last two without text. ``runs`` is the order in which the runs are read. Two columns are read one
    after the other; pages with rotated runs or other directions keep their order. Runs with equal place and index
    keep any order; a null direction, end of line or width counts as not ltr, false, and failed.

    Pages beyond the bounds are found by a partial aggregation of counts first, so no task gathers more than a bounded
    page; all others meet in one shuffle, and a task reads the pages of a batch together.
    """
    units = F.octet_length(F.encode("str", "UTF-16BE")) / 2
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    sound = F.col("str").isNotNull() & (F.size("transform") == 6) & F.forall("transform", finite) & finite(F.col("width")) & finite(F.col("height")) & F.col("item_index").between(0, PAGE_RUNS - 1)
    sizes = runs.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.sum(units).alias("units"))
    large = cut(sizes.where((F.col("n") > PAGE_RUNS) | (F.col("units") > PAGE_UNITS)).select(*PAGE))
    few = large.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES
    gone = large.select(*[F.col(c).alias(f"large_{c}") for c in PAGE])
    same = F.lit(True)
    for c in PAGE:
        same &= F.col(c).eqNullSafe(F.col(f"large_{c}"))
    kept = runs.join(F.broadcast(gone) if few else gone, same, "left_anti").withColumn("sound", F.coalesce(sound, F.lit(False)))
    number = lambda c: F.when(F.col("sound"), F.col(c)).otherwise(0.0).cast("double").alias(c)
    false = lambda c: F.coalesce(c, F.lit(False))
    kept = kept.select(
        *PAGE, F.when(F.col("sound"), F.col("item_index")).otherwise(0).cast("int").alias("item_index"), F.coalesce("str", F.lit("")).alias("str"),
        F.when(F.col("sound"), F.col("transform")).otherwise(F.array_repeat(F.lit(0.0), 6)).cast("array<double>").alias("transform"), number("width"), number("height"),
        false(F.col("dir") == "ltr").alias("ltr"), false("has_eol").alias("has_eol"), false("monospace").alias("monospace"), "sound",
    )
    types = dict(runs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in PAGE) + ", " + RESULT
    found = kept.repartition(*PAGE).sortWithinPartitions(*PAGE, "item_index").mapInArrow(_read, schema)
    return found.unionByName(large.withColumn("outcome", F.lit("capacity")), allowMissingColumns=True)
