"""License scans by conditional compression.

A candidate block is the run of words around words that license notices use. It is read in
overlapping windows of about twice a template's length, so that other words of the block
do not weigh. A window's words, in lower case and joined by blanks, are compressed alone and with
the template as a zstandard raw dictionary. Every template that saves at least `HELD` of its own
bytes is confirmed by exact wording: the differing words between the template and the stretch of
the window that it aligns with. A template is confirmed if all its deciding words (names, version
numbers) are there in place (windows that lack one are not compressed) and at most `DIFFERING` of
its words are not; of the confirmed ones that with the fewest differences wins, then that which
saves the larger share of the block.

Texts without any such word never leave the JVM. Texts are scanned whole; a block of more
than `BLOCK` words is scanned in overlapping parts, so that none is cut where a notice lies.

Defined results: null and empty texts have no block; a block without a confirmed template gives
no row; a block that names several licenses gives a row for each; rows with equal ids are rows
of their own.
"""

from __future__ import annotations

import difflib
import re
from functools import lru_cache, partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices by SPDX identifier, and the words that decide between them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
NAMES = frozenset("mit apache gnu general lesser affero mozilla cc by by-sa by-nc cc0 bsd unencumbered redistribution permission".split())
TRIGGERS = ("licen[sc]e", "copyright", "permission", "redistribution", "public domain", "unencumbered", "spdx", r"\bcc0?\b")

AROUND = 40  # words of a block on each side of a trigger
BLOCK = 400
HELD = 0.05  # of a template's bytes: allowed wordings save 0.16 and more (tested)
DIFFERING = 0.1
_TRIGGER = re.compile("|".join(TRIGGERS), re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _packer(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    data = None if dictionary is None else zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def deciding(word: str) -> bool:
    return word in NAMES or any(c.isdigit() for c in word)


@lru_cache(maxsize=8)
def _templates(templates: tuple[tuple[str, str], ...]):
    """The plain packer, the reach (words that the longest wording takes), and of each template:
    name, words, deciding words, bytes, packer."""
    for name, text in templates:
        if not _TRIGGER.search(text):
            raise ValueError(f"template of {name} holds none of the words that a block starts from")
    made = []
    for name, text in templates:
        words = words_of(text)
        raw = " ".join(words).encode()
        made.append((name, words, set(filter(deciding, words)), len(raw), _packer(raw)))
    return _packer(None), max([AROUND, *(_longest(t[1]) for t in made)]), made


def _longest(template: list[str]) -> int:
    return len(template) + int(DIFFERING * len(template))


def differences(template: list[str], words: list[str]) -> tuple[int, int, int, list[str]] | None:
    """(first word, last word + 1, number of differing words, the differences) of the stretch of
    words that the template aligns with best; None where nothing aligns or a deciding word
    lacks or another stands in its place."""
    match = difflib.SequenceMatcher(None, template, words, autojunk=False)
    blocks = [b for b in match.get_matching_blocks() if b.size]
    if not blocks:
        return None
    start, stop = blocks[0].b - blocks[0].a, blocks[-1].b + len(template) - blocks[-1].a
    start, stop = max(start, 0), min(max(stop, 0), len(words))
    found, changed = [], 0
    for op, a, b, c, d in difflib.SequenceMatcher(None, template, words[start:stop], autojunk=False).get_opcodes():
        if op == "equal":
            continue
        lost, new = template[a:b], words[start + c : start + d]
        if any(map(deciding, lost)) or any(map(deciding, new)):
            return None
        changed += max(len(lost), len(new))
        found += [f"-{w}" for w in lost] + [f"+{w}" for w in new]
    return start, stop, changed, found


def blocks_of(text: str, around: int = AROUND) -> list[list[tuple[int, int, str]]]:
    """Runs of (start, end, word) around the triggers, in parts of at most BLOCK words."""
    if not _TRIGGER.search(text):
        return []
    words = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text)]
    starts, hits, at = [w[0] for w in words], [], 0
    for m in _TRIGGER.finditer(text):
        while at + 1 < len(starts) and starts[at + 1] <= m.start():
            at += 1
        if not hits or hits[-1] != at:
            hits.append(at)
    spans: list[list[int]] = []
    for h in hits:
        a, b = max(h - around, 0), min(h + around + 1, len(words))
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    size = max(BLOCK, 2 * around)
    return [words[k : min(k + size, b)] for a, b in spans for k in range(a, max(b - around, a + 1), size - around)]


def confirmed(words: list[str], template: tuple, plain: zstandard.ZstdCompressor) -> tuple[int, int, int, list[str]] | None:
    """The differences, as differences() has them, at the place in the words where the template
    differs least; None where no wording of it is."""
    _, own, needed, held, packer = template
    best = None
    if not needed.issubset(words):
        return None
    # a wording takes at most _longest words, so that one window holds all of it
    for k in range(0, max(len(words) - _longest(own), 0) + len(own), len(own)):
        window = words[k : k + len(own) + _longest(own)]
        if not needed.issubset(window):
            continue
        raw = " ".join(window).encode()
        if len(plain.compress(raw)) - len(packer.compress(raw)) < HELD * held:
            continue
        d = differences(own, window)
        if d is not None and d[2] <= DIFFERING * len(own) and (best is None or d[2] < best[2]):
            best = (k + d[0], k + d[1], d[2], d[3])
    return best


def scan(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[dict]:
    """The confirmed notices of a text."""
    plain, around, made = _templates(templates)
    found: dict[tuple[int, int], dict] = {}
    for block in blocks_of(text or "", around):
        left = block
        while left:  # a block may name several licenses: search on without the words of the last
            words = [w[2] for w in left]
            met = [(d, t) for t in made if (d := confirmed(words, t, plain)) is not None]
            if not met:
                break
            raw = " ".join(words).encode()
            alone = len(plain.compress(raw))
            shares = [1 - len(t[4].compress(raw)) / alone for _, t in met]
            i = min(range(len(met)), key=lambda i: (met[i][0][2], -shares[i]))
            (a, b, changed, diff), (name, *_) = met[i]
            place = (left[a][0], left[b - 1][1])
            found.setdefault(place, {"start": place[0], "end": place[1], "license": name, "saved": round(shares[i], 6), "n_differing": changed, "differing": " ".join(diff)})
            left = left[:a] + left[b:]
    whole: list[dict] = []  # without wordings that the end of a part cut, which the next part holds whole
    for r in sorted(found.values(), key=lambda r: (r["n_differing"], r["start"], r["end"])):
        if not any(r["license"] == o["license"] and r["start"] < o["end"] and o["start"] < r["end"] for o in whole):
            whole.append(r)
    return sorted(whole, key=lambda r: (r["start"], r["end"], r["license"]))


_ROW = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("n_differing", pa.int64()), ("differing", pa.string())])


def _scan(batches, templates):
    for batch in batches:
        ids, rows = [], []
        for d, text in zip(batch.column("doc_id"), batch.column("__text").to_pylist(), strict=True):
            for r in scan(text, templates):
                ids.append(d.as_py())
                rows.append(r)
        found = pa.array(rows, _ROW)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), *(found.field(i) for i in range(_ROW.num_fields))], ["doc_id", *(f.name for f in _ROW)])


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, start and end (characters), license, saved (the share of the block's bytes),
    n_differing and differing (words lost and new) of each confirmed notice. templates: names and
    texts; each text holds a trigger."""
    _templates(tuple(templates))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).where(F.col("__text").rlike("(?i)" + "|".join(TRIGGERS)))
    kinds = {"start": "long", "end": "long", "license": "string", "saved": "double", "n_differing": "long", "differing": "string"}
    return own.mapInArrow(partial(_scan, templates=tuple(templates)), own.select("doc_id", *(F.lit(None).cast(k).alias(c) for c, k in kinds.items())).schema)
