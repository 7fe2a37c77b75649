import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.conftest import LONG, PASSAGE, ROWS
from trafficloom.llm import (
    bloom_lm,
    chat,
    decontaminate,
    langid,
    licenses,
    line_chunks,
    mixing,
    quality,
    queries,
    set_join,
    token_files,
)
from trafficloom.llm.components import connected
from trafficloom.llm.tables import table, written

VOCABULARY = public_tokenizers.path(queries.VOCABULARY)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def counted(values):
    return collections.Counter(values)


# ----- chat ----------------------------------------------------------------

TRANSCRIPT = [
    (0, "System: be kind", "system"),
    (1, "User: what is it?\nsecond line", "user"),
    (2, "Assistant: a thing", "assistant"),
    (3, "and no marker here?", "user"),
    (4, "Assistant: more\nUser: quoted", "assistant"),
]


@pytest.fixture(scope="module")
def transcripts(llm_spark):
    rows = queries.as_transcripts(llm_spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    return rows, chat.fit(rows)


def one_pass(model, texts):
    seen, lines = chat.symbols(texts)
    out = []
    for state, (_, _, line) in zip(chat.decode(model, seen), lines):
        if state % 2 == 0:
            out.append([chat.ROLES[state // 2], [line[chat.marker(line)[1] :]]])
        else:
            out[-1][1].append(line)
    return "".join(f"<|{role}|>\n" + "\n".join(part).strip("\n") + "\n" for role, part in out)


@pytest.mark.parametrize("block_rows,fan", [(64, 1024), (2, 2)])
def test_chat_blocks_give_the_one_pass_result(transcripts, monkeypatch, block_rows, fan):
    rows, model = transcripts
    monkeypatch.setattr(chat, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(chat, "FAN", fan)
    found = chat.format_transcripts(rows, model).toPandas().sort_values(["conv_id", "seq", "line"])
    rendered = found.groupby("conv_id").rendered.apply("".join).to_dict()
    given = rows.toPandas().sort_values(["conv_id", "seq"])
    for conv, group in given.groupby("conv_id"):
        # Pieces of one turn in two blocks are joined by a line feed either way.
        assert rendered[conv] == one_pass(model, group.text.tolist())
    starts = {(r.conv_id, r.seq): r.role for r in found.itertuples() if r.starts and r.line == 0}
    right = [starts.get((r.conv_id, r.seq)) == r.role for r in given.itertuples()]
    assert np.mean(right) > 0.95


def test_chat_odd_rows(llm_spark, transcripts):
    _, model = transcripts
    schema = "conv_id bigint, seq bigint, text string, entry string"
    data = [(1, 0, None, "x"), (1, 0, None, "x"), (None, None, "User: hi", "x"), (2, 0, "", "x"), (3, 0, "User: " + LONG, None)]
    found = chat.format_transcripts(llm_spark.createDataFrame(data, schema), model).collect()
    by_conv = collections.defaultdict(list)
    for r in found:
        by_conv[r.conv_id].append(r)
    assert set(by_conv) == {1, 2, 3, None}
    assert by_conv[None][0].role == "user" and by_conv[None][0].text == "hi"
    assert by_conv[3][0].text == LONG.strip("\n")
    assert all(r.text == "" for r in by_conv[1] + by_conv[2])
    assert chat.format_transcripts(llm_spark.createDataFrame([], schema), model).count() == 0


# ----- mixing --------------------------------------------------------------


def targets_by_hand(sizes):
    """Water filling by rounds: capped sources keep their cap, the rest is shared again."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [n for n in names if n not in capped]
        rest = total - sum(capped.values())
        share = {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 3 * sizes[n]]
        if not over:
            return {**capped, **share}
        capped.update({n: 3.0 * sizes[n] for n in over})


def check_mix(found):
    sizes = collections.Counter()
    for r in found:
        sizes[r.source] += r["size"]
    targets = targets_by_hand(sizes)
    taken = collections.Counter()
    for r in found:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, targets[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.epochs * r["size"] + r.extra
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert taken[source] == math.floor(target + 1e-9)


def test_mix_meets_targets(llm_spark, sample, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 20)
    found = mixing.mix_sources(table(llm_spark, sample, "documents")).collect()
    check_mix(found)
    again = mixing.mix_sources(table(llm_spark, sample, "documents").repartition(3)).collect()
    assert counted(found) == counted(again)
    odd = mixing.mix_sources(odd_docs).collect()
    assert len(odd) == len(ROWS)
    check_mix(odd)
    assert mixing.mix_sources(no_docs).count() == 0


def test_mixed_documents_hold_the_words_taken(llm_spark, odd_docs, no_docs):
    plan, wanted = mixing.mix_sources(odd_docs).collect(), collections.Counter()
    for r in plan:
        wanted[r.source] += r.taken
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    held = collections.Counter()
    for r in mixed.collect():
        held[r.source] += len(brute.WORD.findall(r.text))
    assert +held == +wanted
    assert mixing.mixed_documents(no_docs).count() == 0


def test_first_words(llm_spark):
    df = llm_spark.createDataFrame([("  a b\n c  d ", 3), ("a b", 2), ("a", 1)], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["  a b\n c", "a b", "a"]


# ----- quality -------------------------------------------------------------


def test_quality_counts_and_verdict(llm_spark, sample, odd_docs, no_docs):
    docs, labels = table(llm_spark, sample, "documents"), table(llm_spark, sample, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id: r.quality for r in labels.collect()}
    kept = collections.defaultdict(list)
    for r in quality.judge(docs, labels.where("quality = 1")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(texts[r.doc_id])
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.score >= quality.THRESHOLD)
        if r.doc_id in good and not failed:
            kept[good[r.doc_id]].append(r.kept)
    assert np.mean(kept[1]) > 0.95 and np.mean(kept[0]) < 0.2
    odd = quality.judge(odd_docs, labels.where("false")).collect()
    assert len(odd) == len(ROWS) and all(r.score == 0 for r in odd)
    given = counted(brute.quality(r[1]) for r in ROWS)
    assert counted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in odd) == given
    assert quality.judge(no_docs, labels).count() == 0


def test_quality_score_by_hand(llm_spark, sample):
    docs = table(llm_spark, sample, "documents").limit(40)
    slots = {
        r.doc_id: r.s
        for r in docs.withColumn("shapes", quality.shapes(F.col("text"))).select("doc_id", quality.slots_of(F.col("shapes")).alias("s")).collect()
    }
    trusted = sorted(slots)[:10]
    raw = collections.Counter(s for v in slots.values() for s in v)
    own = collections.Counter(s for d in trusted for s in slots[d])
    n, t = sum(raw.values()), sum(own.values())
    ratio = {s: math.log((own[s] + 1) / (t + quality.SLOTS)) - math.log((raw[s] + 1) / (n + quality.SLOTS)) for s in raw}
    chosen = llm_spark.createDataFrame([(d,) for d in trusted], "doc_id bigint")
    for r in quality.judge(docs, chosen).collect():
        assert math.isclose(r.score, np.mean([ratio[s] for s in slots[r.doc_id]]), abs_tol=1e-9)


# ----- line dedup ----------------------------------------------------------


def by_hand(docs):
    seen, out = set(), {}
    for doc_id, text in sorted(docs.items()):
        kept = []
        for _, lines, data in line_chunks.chunks(text):
            if lines >= line_chunks.MIN_LINES and data.strip():
                if data in seen:
                    continue
                seen.add(data)
            kept.append(data)
        out[doc_id] = b"\n".join(kept).decode()
    return out


def test_line_chunks_against_brute_force(llm_spark, sample, odd_docs, no_docs):
    docs = table(llm_spark, sample, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = line_chunks.dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in found} == by_hand(texts)
    assert sum(r.n_removed for r in found) > 0
    odd = line_chunks.dedup_lines(odd_docs).collect()
    assert len(odd) == len(ROWS)
    assert counted(r.n_lines for r in odd) == counted(0 if r[1] is None else r[1].count("\n") + 1 for r in ROWS)
    # Rows equal in id and text are one document.
    assert [r.n_removed for r in odd if r.doc_id == 9] == [0, 0]
    assert line_chunks.dedup_lines(no_docs).count() == 0


def test_chunk_boundaries_resist_shifts():
    lines = [f"line number {i}" for i in range(200)]
    inside = {c[2] for c in line_chunks.chunks("\n".join(lines))}
    shifted = {c[2] for c in line_chunks.chunks("\n".join(["new", "lines", "before", *lines]))}
    assert len(inside & shifted) >= len(inside) - 2


def runs_by_hand(docs):
    """Every run of two filled lines or more is looked up at all its places, for (doc_id, text) pairs."""
    docs = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    lines = [(t or "").split("\n") for _, t in docs]
    places = collections.defaultdict(list)
    for d, own in enumerate(lines):
        for i in range(len(own)):
            for j in range(i + 2, min(len(own), i + 12) + 1):
                if own[i].strip() and own[j - 1].strip():
                    places[tuple(own[i:j])].append((d, i))
    gone = collections.defaultdict(set)
    for run, at in places.items():
        for d, i in sorted(at)[1:]:
            gone[d].update(range(i, i + len(run)))
    return {
        docs[d]: (len(gone[d]), None if docs[d][1] is None else "\n".join(x for i, x in enumerate(own) if i not in gone[d]))
        for d, own in enumerate(lines)
    }


def test_repeated_runs_against_brute_force(llm_spark, sample, odd_docs, no_docs):
    a, b, c = ("a short passage", "of only three lines", "that chunks may miss")
    docs = [(1, f"{a}\n{b}\n{c}"), (2, f"x\n{a}\n{b}\ny"), (3, f"{c}\nz\n\n \n{b}\n{c}"), (4, f"p\n\n \nq\n{a}"), (5, "w\nw\nw\nw")]
    # A heading with a blank line is no run, nor is a line with the end of a text; blank lines inside a run are its own.
    docs += [(6, "Introduction\n\nsix"), (7, "Introduction\n\nseven"), (8, "y\nReferences\n"), (9, "z\nReferences\n")]
    docs += [(10, "m\n\nn"), (11, "m\n\nn\n\no"), (12, "m\nn")]
    small = llm_spark.createDataFrame(docs, "doc_id bigint, text string")
    for df in (small, table(llm_spark, sample, "documents")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        wanted = runs_by_hand(rows)
        found = line_chunks.dedup_runs(df).collect()
        assert counted((r.doc_id, r.n_removed, r.text) for r in found) == counted((r[0], *wanted[r]) for r in rows)
    # The registered query takes whole runs, and no blank lines that stand alone.
    texts = {r.doc_id: r.text for r in line_chunks.dedup_runs(small).collect()}
    changed = {2: "x\ny", 3: f"{c}\nz\n\n ", 5: "w", 11: "\no"}
    assert texts == {**dict(docs), **changed}
    run = queries.QUERIES["op4_line_chunks"](llm_spark, sample)
    assert counted((r.doc_id, r.text) for r in run.collect()) == counted((r.doc_id, r.text) for r in found)
    odd = line_chunks.dedup_runs(odd_docs).collect()
    assert counted(r.n_lines for r in odd) == counted(0 if r[1] is None else r[1].count("\n") + 1 for r in ROWS)
    assert {r.doc_id: r.text for r in odd}[2] == "" and [r.n_removed for r in odd if r.doc_id == 9] == [0, 0]
    assert line_chunks.dedup_runs(no_docs).count() == 0


# ----- language model ------------------------------------------------------


@pytest.mark.parametrize("head", [1_000_000, 50])
def test_base_score_is_exact(llm_spark, sample, monkeypatch, head):
    monkeypatch.setattr(bloom_lm.head_of, "__defaults__", (head,))
    docs = table(llm_spark, sample, "documents").select("doc_id", "text")
    tokens = {r.doc_id: [*brute.words(r.text), "\n"] for r in docs.collect()}
    held = {d for d in tokens if zlib.crc32(str(d).encode()) % 5 == 1}
    counts = collections.Counter(t for d, ts in tokens.items() if d not in held for t in ts)
    gained = 0
    for r in bloom_lm.score_documents(docs, queries.id_fold(5) != 1).collect():
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), sum(counts.values()))
        assert math.isclose(r.base_score, brute.base_score(own, counts), rel_tol=1e-9)
        gained += r.score - r.base_score
    assert gained > 0


def test_filter_levels(llm_spark, sample):
    docs = table(llm_spark, sample, "documents").select("text")
    held = bloom_lm.gathered(bloom_lm.build_segments(docs, 4, 4), 4)
    import pyarrow as pa

    from trafficloom.llm.words import split_words

    texts = pa.array([r.text for r in docs.collect()])
    now, before, _ = bloom_lm.token_runs(split_words(texts))
    pairs, counts = np.unique(bloom_lm.pair_hash(before, now), return_counts=True)
    levels = held.levels(pairs)
    # Never below the true level, seldom above.
    assert (levels >= bloom_lm.levels_of(counts)).all()
    assert (levels > bloom_lm.levels_of(counts)).mean() < 0.02
    absent = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (held.levels(absent) > 0).mean() < 0.02
    # It is broadcast only if all of it fits.
    assert bloom_lm.gathered(bloom_lm.build_segments(docs, 4), 4, 1 << 12) is None


def test_language_model_odd_rows(llm_spark, odd_docs, no_docs):
    found = bloom_lm.score_documents(odd_docs, F.lit(True)).collect()
    assert counted(r.n_tokens for r in found) == counted(len(brute.words(r[1])) + 1 for r in ROWS)
    assert all(r.n_known == r.n_tokens for r in found)
    unlearned = bloom_lm.score_documents(odd_docs, F.lit(False)).collect()
    assert len(unlearned) == len(ROWS) and all(r.n_known == 0 and math.isfinite(r.score) for r in unlearned)
    assert bloom_lm.score_documents(no_docs, F.lit(True)).count() == 0


def scores_by_hand(docs, held_out):
    tokens = [(d, [*brute.words(t), "\n"]) for d, t in docs]
    words, pairs = collections.Counter(), collections.Counter()
    for d, own in tokens:
        if d not in held_out:
            words.update(["\0", *own])
            pairs.update(zip(["\0", *own], own))
    size = sum(words.values()) - words["\0"]
    values = bloom_lm.level_values()

    def count(n):
        return values[bloom_lm.levels_of(np.array([n]))[0]] if n else 0.0

    below = size + 0.5 * (len(words) - ("\0" in words) + 1)
    out = []
    for d, own in tokens:
        total = 0.0
        for before, now in zip(["\0", *own], own):
            single, previous = (count(words[now]) + 0.5) / below, count(words[before])
            pair = min(count(pairs[before, now]), count(words[now]), previous)
            total += math.log10((pair + bloom_lm.PRIOR * single) / (previous + bloom_lm.PRIOR))
        out.append((len(own), round(total, 4)))
    return counted(out)


@pytest.mark.parametrize("entries", [1 << 21, 1 << 14])
def test_scores_are_the_same_by_broadcast_and_by_shuffle(llm_spark, sample, odd_docs, no_docs, monkeypatch, entries):
    monkeypatch.setattr(bloom_lm, "ENTRIES_PER_SEGMENT", entries)
    docs = table(llm_spark, sample, "documents").select("doc_id", "text")
    for df, learn in ((docs, queries.id_fold(5) != 1), (odd_docs, F.lit(True)), (odd_docs, F.lit(False)), (no_docs, F.lit(True))):
        found = [bloom_lm.score_documents(df, learn, filter_bits=bits, block_bytes=1 << 14).collect() for bits in (bloom_lm.FILTER_BITS, 0)]
        assert counted(found[0]) == counted(found[1]) and len(found[0]) == df.count()


def test_scores_against_brute_force(llm_spark, sample, odd_docs):
    # So many bits that hardly a probe is answered wrongly.
    bits = 1 << 8
    docs = table(llm_spark, sample, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 1}
    found = bloom_lm.score_documents(docs, queries.id_fold(5) != 1, entry_bits=bits).collect()
    assert counted((r.n_tokens, round(r.score, 4)) for r in found) == scores_by_hand(rows, held)
    for learn, held in ((True, set()), (False, {r[0] for r in ROWS})):
        found = bloom_lm.score_documents(odd_docs, F.lit(learn), entry_bits=bits).collect()
        assert counted((r.n_tokens, round(r.score, 4)) for r in found) == scores_by_hand([r[:2] for r in ROWS], held)


# ----- licences ------------------------------------------------------------


def test_licences(llm_spark, odd_docs, no_docs):
    from trafficloom.llm.license_texts import KNOWN

    known = licenses.known_table(llm_spark)
    assert counted(rows_of(licenses.scan_licenses(odd_docs, known))) == counted([(9, None, "Apache-2.0"), (9, 1, "Apache-2.0")] * 2)
    assert licenses.scan_licenses(no_docs, known).count() == 0
    mit = "The Thing\n".replace("The Thing\n", "") + "Copyright (c) 2020 Someone\n\n" + KNOWN["MIT"].upper().replace(",", " ;")
    docs = llm_spark.createDataFrame([(1, mit), (2, mit + " more"), (3, KNOWN["ISC"])], "doc_id bigint, text string")
    assert sorted(rows_of(licenses.scan_licenses(docs, known))) == [(1, None, "MIT"), (3, None, "ISC")]


def test_canonical_forms_agree(llm_spark):
    texts = ["The Licence,\n(c) me\nis  Favourable & whilst — ok", "", " \n", "LICENCE licence"]
    df = llm_spark.createDataFrame([(t,) for t in texts], "t string").withColumn("lines", licenses.word_lines(F.col("t")))
    whole = F.array_join(F.filter("lines", lambda w: w != ""), " ")
    assert [r[0] for r in df.select(licenses.respelled(whole)).collect()] == [licenses.canonical_text(t) for t in texts]


def test_whole_licences_however_wrapped(llm_spark):
    from trafficloom.llm.license_texts import KNOWN, full_texts

    texts = dict((name, text) for text, name in reversed(full_texts()))
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 Nancy Holt\n\n" + KNOWN["MIT"]), ("MIT", "Copyright Nancy\n" + KNOWN["MIT"])]
    # The built-in wrapping begins a line with "copyright notice and"; this one does not.
    rows += [("ISC", "Copyright 2020 by me\n" + " ".join(KNOWN["ISC"].split()))]
    rows += [(name, "\n\n\n" + text) for name, text in texts.items()]
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "Unlicense", "CC0-1.0"} <= set(texts)
    docs = llm_spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id bigint, text string")
    found = licenses.scan_licenses(docs, licenses.known_table(llm_spark)).where("line is null")
    assert {r.doc_id: r.license for r in found.collect()} == {i: name for i, (name, _) in enumerate(rows)}


# ----- decontamination -----------------------------------------------------


def test_leaks_against_brute_force(llm_spark, sample):
    docs, items = table(llm_spark, sample, "documents"), table(llm_spark, sample, "benchmark")
    whole = {r.item_id: brute.shingles(r.text) for r in items.collect()}
    wanted = set()
    for d in docs.collect():
        own = brute.shingles(d.text)
        wanted |= {(d.doc_id, i) for i, s in whole.items() if len(s & own) >= 0.8 * len(s)}
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert wanted and wanted <= found
    near = {(d, i) for d, i in found if (d, i) not in wanted}
    assert len(near) <= 1


def test_leaks_odd_rows(llm_spark, odd_docs, no_docs):
    items = [(1, "Which words are these? " + PASSAGE), (2, None), (3, ""), (None, PASSAGE), (4, "other words that no text has. at all")]
    benchmark = llm_spark.createDataFrame(items, "item_id bigint, text string")
    found = counted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd_docs, benchmark).collect())
    assert found == counted((d, None) for d in (1, 2, 3, None))
    assert decontaminate.find_leaks(no_docs, benchmark).count() == 0
    assert decontaminate.find_leaks(odd_docs, benchmark.where("false")).count() == 0


def test_a_leak_in_a_very_long_text(llm_spark):
    docs = llm_spark.createDataFrame([(1, LONG + " " + PASSAGE + " " + LONG)], "doc_id bigint, text string")
    benchmark = llm_spark.createDataFrame([(7, PASSAGE)], "item_id bigint, text string")
    assert [tuple(r)[:2] for r in decontaminate.find_leaks(docs, benchmark).collect()] == [(1, 7)]


# ----- Jaccard join --------------------------------------------------------


@pytest.fixture(scope="module")
def groups():
    random = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        base = [f"w{random.integers(10_000)}" for _ in range(random.integers(6, 120))]
        for _ in range(5):
            own = list(base)
            for _ in range(random.integers(0, 4)):
                own[random.integers(len(own))] = f"e{random.integers(10_000)}"
            texts.append(" ".join(own))
    texts += [PASSAGE, PASSAGE, "a b", "a b", "a b c", "", " ", None]
    return dict(enumerate(texts, 100))


def test_join_against_brute_force(llm_spark, groups):
    docs = llm_spark.createDataFrame(list(groups.items()), "doc_id bigint, text string").repartition(3)
    sets = {k: brute.shingles(t) for k, t in groups.items()}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.jaccard_components(docs).collect()}
    wanted = brute.components(sets)
    assert found == {k: (len(s), wanted[k]) for k, s in sets.items()}


def test_join_of_the_small_tables(llm_spark, sample):
    docs = table(llm_spark, sample, "documents")
    wanted = brute.components({r.doc_id: brute.shingles(r.text) for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in set_join.jaccard_components(docs).collect()} == wanted


def test_join_odd_rows(llm_spark, odd_docs, no_docs):
    found = set_join.jaccard_components(odd_docs).collect()
    assert len(found) == len(ROWS)
    parts = collections.defaultdict(set)
    for r in found:
        parts[r.doc_id].add(r.component_id)
    assert parts[1] == parts[2] == parts[3] == {1} and parts[9] == {9} and parts[4] == {4} and parts[5] == {5}
    assert parts[None] == {None}
    assert set_join.jaccard_components(no_docs).count() == 0


def test_light_keys_meet_for_every_pair_that_links():
    """Two sets of similarity 0.8 meet often enough, whatever the boundary."""
    random = np.random.default_rng(5)
    for light in (0, 10, 30, 64):
        for _ in range(200):
            n = int(random.integers(4, 60))
            base = random.integers(1, 1 << 62, n).astype(np.uint64)
            other = np.concatenate((base[: max(1, n - int(random.integers(0, max(n // 5, 1) + 1)))], random.integers(1, 1 << 62, int(random.integers(0, 4))).astype(np.uint64)))
            a, b = np.unique(base), np.unique(other)
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)) or np.array_equal(a, b):
                continue
            keys, owner = set_join._keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), light, 80)
            shared = np.intersect1d(keys[owner == 0], keys[owner == 1])
            lists = int((shared & np.uint64(1)).sum())
            # A shared key of a pair, or as many lists as the smaller set asks for.
            assert len(shared) > lists or lists >= set_join.meetings(min(len(a), len(b)))


@pytest.mark.parametrize("boundary", [0, 64])
def test_no_link_is_lost_where_members_meet_only_near_their_start(llm_spark, monkeypatch, boundary):
    """Sets on both sides of the limit, of all sizes: heavy ones by lists alone, light ones by pairs."""
    monkeypatch.setattr(set_join, "light_boundary", lambda *_: boundary)
    random = np.random.default_rng(11)
    texts = []
    for n in (7, 12, 25, 40, 60, 90, 150):
        base = [f"b{n}_{i}" for i in range(n + 4)]
        texts.append(" ".join(base))
        for k in range(12):
            # Edits at places of their own, some words more or fewer, some edits shared.
            own = list(base) if k % 3 else base[: -max(1, n // 10)]
            for _ in range(random.integers(0, max(2, n // 22))):
                own[random.integers(len(own))] = f"e{random.integers(3 if k % 2 else 10_000)}"
            texts.append(" ".join(own + [f"t{k}"] * (k % 4)))
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    sets = {k: brute.shingles(t) for k, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in set_join.jaccard_components(docs).collect()} == brute.components(sets)


def test_variants_that_differ_too_much_do_not_meet_pair_by_pair(llm_spark, monkeypatch):
    """Copies with many edits of their own share common elements, and none links."""
    met, meet = [], set_join.meetings_apart
    monkeypatch.setattr(set_join, "meetings_apart", lambda *args: met.append(meet(*args)) or met[-1])
    random = np.random.default_rng(2)
    base = [f"b{i}" for i in range(304)]
    texts = []
    for k in range(60):
        own = list(base)
        for i in random.choice(60, 11, replace=False):
            own[5 * i + 2] = f"e{k}_{i}"
        texts.append(" ".join(own))
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    sets = {k: brute.shingles(t) for k, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in set_join.jaccard_components(docs).collect()} == brute.components(sets)
    assert met[0].count() <= len(texts)


@pytest.mark.parametrize("changes, places", [((1, 5), 150), ((2, 5), 150), ((2, 6), 90)])
def test_members_of_a_family_meet_by_what_they_have_apart(llm_spark, monkeypatch, changes, places):
    """Variants around the limit, some with edits in common; the text they come from is none of them."""
    met, meet = [], set_join.meetings_apart
    monkeypatch.setattr(set_join, "meetings_apart", lambda *args: met.append(meet(*args)) or met[-1])
    random = np.random.default_rng(places)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(150):
        own = list(base)
        for i in random.choice(places, random.integers(*changes), replace=False):
            own[i] = f"e{i}_{random.integers(2) if k % 3 else k}"
        texts.append(" ".join(own))
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    sets = {k: brute.shingles(t) for k, t in enumerate(texts)}
    wanted = brute.components(sets)
    assert 3 < len(set(wanted.values())) < len(texts)
    assert {r.doc_id: r.component_id for r in set_join.jaccard_components(docs).collect()} == wanted
    assert met[0].count() <= 3 * len(texts)


def test_members_of_too_few_lists_do_not_go_to_the_second_round(llm_spark, monkeypatch):
    """Every two texts share a passage, and none links: what they share is less than any link asks for."""
    placed, meet = [], set_join.meetings_apart
    monkeypatch.setattr(set_join, "meetings_apart", lambda *args: placed.append(args[0].count()) or meet(*args))
    lists, own = [], set_join.own_elements
    monkeypatch.setattr(set_join, "own_elements", lambda *args: lists.append(args[0].count()) or own(*args))
    texts = []
    for k in range(30):
        passages = [f"p{min(k, i)}_{max(k, i)}" for i in range(30) if i != k]
        texts.append(" ".join(f"{p}_{j}" for p in passages for j in range(17)))
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in set_join.jaccard_components(docs).collect()} == {k: k for k in range(30)}
    assert lists[0] > 30 and placed == [0]


def test_no_link_is_lost_where_places_are_late(llm_spark, groups, monkeypatch):
    """Places that a row of a list has no room for count as the last one."""
    monkeypatch.setattr(set_join, "LAST_PLACE", 3)
    docs = llm_spark.createDataFrame(list(groups.items()), "doc_id bigint, text string").repartition(3)
    wanted = brute.components({k: brute.shingles(t) for k, t in groups.items()})
    assert {r.doc_id: r.component_id for r in set_join.jaccard_components(docs).collect()} == wanted


def test_written_sends_batches_of_few_bytes_to_python(llm_spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before = [llm_spark.conf.get(n) for n in names]
    docs = llm_spark.range(0, 4_000, 1, 1).selectExpr("repeat('x', 8000) AS text")
    found = written(docs.mapInArrow(sizes, "bytes bigint"), "batches").selectExpr("max(bytes)", "sum(bytes)").first()
    assert found[0] < 5 << 20 and found[1] > 30 << 20
    assert [llm_spark.conf.get(n) for n in names] == before


def test_components(llm_spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 42), (42, 40), (50, 50), (None, 3), (3, 2)]
    df = llm_spark.createDataFrame(links, "a bigint, b bigint")
    found = dict(rows_of(connected(df)))
    assert found == {**{i: 1 for i in range(1, 31)}, 40: 40, 41: 40, 42: 40}
    assert connected(df.where("false")).count() == 0


# ----- token files ---------------------------------------------------------


def expected_tokens(rows):
    tokenizer, at, out = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(llm_spark, sample, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "PART_TOKENS", 50_000)
    docs = table(llm_spark, sample, "documents")
    found = sorted(rows_of(token_files.token_digests(docs, VOCABULARY)))
    assert found == expected_tokens([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert token_files.token_digests(no_docs, VOCABULARY).count() == 0


def test_token_files_odd_rows(llm_spark, odd_docs):
    found = rows_of(token_files.token_digests(odd_docs, VOCABULARY))
    wanted = counted((d, n, c) for d, _, n, c in expected_tokens([r[:2] for r in ROWS]))
    assert counted((d, n, c) for d, _, n, c in found) == wanted
    in_order = sorted(found, key=lambda r: r[1])
    assert [r[1] for r in in_order] == [sum(x[2] for x in in_order[:i]) for i in range(len(in_order))]
    ids = [r[0] for r in in_order]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])


def test_units_encode_like_whole_texts():
    import pyarrow as pa

    from trafficloom.llm.tokenize_words import UnitEncoder

    odd = [
        "it's <|endoftext|> x<|endoftext|>y 12a3 é́ é ſ K'S 'tis don't!! a—b “q” ß İ x y ٣٤ ñ.",
        "", "  ", None, "A.B.C l'été — ... !?'s '", "__a _b (x) <|x|> 你好。你 naïve z ABC!! é.. ,,x", "a\x00b ª º ﬁ Ⅷ.. ²! x²,×3 ÷",
    ]
    one = UnitEncoder(VOCABULARY)
    for _ in range(2):
        ids, bounds = one.encode(pa.array(odd))
        for i, text in enumerate(odd):
            whole = one.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == whole


# ----- language ------------------------------------------------------------


def test_language_of_held_out_documents(llm_spark):
    docs = table(llm_spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, queries.id_fold(4) != 2)
    held = langid.classify(docs.where(queries.id_fold(4) == 2), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_odd_rows(llm_spark, odd_docs, no_docs):
    model = langid.train(odd_docs, F.lit(True))
    assert model.languages == ["de", "en"]
    plain = odd_docs.drop("score")
    found = langid.classify(plain, model)
    assert found.columns == [*plain.columns, "lang_pred", "score"]
    by_text = {r.text: r.lang_pred for r in found.collect()}
    assert by_text[None] == by_text[""] == by_text[" \n\t\n "] == by_text["\U0001f600 ??? 123"] == "und"
    assert by_text[LONG] == "de" and by_text[PASSAGE + "\nand more\nlines here"] == "en"
    assert langid.classify(no_docs.drop("score"), model).count() == 0
    none = langid.train(no_docs, F.lit(True))
    assert {r.lang_pred for r in langid.classify(plain, none).collect()} == {"und"}


def test_kernel_is_the_normalised_number_of_shared_ngrams():
    import pyarrow as pa

    bits = langid.presence(pa.array(["abab", "ABAB", "abc", ""]))
    assert (bits[0] == bits[1]).all()
    a = {"a", "b", "ab", "ba", "aba", "bab", "abab"}
    c = {"a", "b", "c", "ab", "bc", "abc"}
    assert bits[0].sum() == len(a) and bits[2].sum() == len(c) and bits[3].sum() == 0
    assert math.isclose(langid.kernel(bits[:1], bits[2:3])[0, 0], len(a & c) / math.sqrt(len(a) * len(c)), rel_tol=1e-6)
