"""License scanning with MinHash bands over overlapping windows.

Texts become five-word shingles. Overlapping windows of shingles, in sizes that
fit the templates, are summarised by minima of hash functions. A band equal to
a template's band makes the window a candidate; exact containment of the
template's shingles in the words around the window decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.base import pieces, text_bytes
from tomeweave.llm.bytewords import ODD_A, ODD_B, Words
from tomeweave.session import ship_package

SHINGLE = 5
CONTAINMENT = 0.8
PIECE_BYTES = 2 << 20

#: Notices by which texts state their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Bands:
    """``bands`` of ``rows`` minima each. A window and a template of Jaccard similarity s meet with 1 - (1 - s^rows)^bands."""

    bands: int = 40
    rows: int = 1

    def probability(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def least_similarity(size: int, width: int, containment: float = CONTAINMENT) -> float:
    """Of a template of ``size`` shingles and a full window that holds ``containment`` of them."""
    return containment * size / (width + (1 - containment) * size)


def window_width(level: int) -> int:
    return 3 << level


def level_of(size: int) -> int:
    """Level k has windows of 3 * 2^k shingles every 2^k: any run of 2^(k+1) shingles lies in one."""
    return max(0, (size - 1).bit_length() - 1)


def mixers(bands: Bands) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, bands.bands * bands.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_keys(words: np.ndarray) -> np.ndarray:
    """One key for each run of ``SHINGLE`` word keys."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        key = key * ODD_A + words[k : k + n]
        key ^= key >> np.uint64(31)
    return key * ODD_B


def mixed(keys: np.ndarray, mixer: np.uint64) -> np.ndarray:
    value = keys * mixer
    return value ^ (value >> np.uint64(32))


@dataclass
class Template:
    name: str
    shingles: set[bytes]
    level: int
    minima: np.ndarray


@dataclass
class Templates:
    bands: Bands
    each: list[Template] = field(default_factory=list)
    #: per level and band: the templates' bands in order, and whose they are
    index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)


def _shingles(data: bytes) -> list[bytes]:
    words = WORD.findall(data.lower())
    return [b" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)]


def prepare(templates: dict[str, str] | None = None, bands: Bands = Bands(), least: float = 0.999) -> Templates:
    """Templates with their bands. Settings that would miss a window more often than ``1 - least`` are refused."""
    out = Templates(bands)
    for name, text in sorted((TEMPLATES if templates is None else templates).items()):
        data = text.encode()
        found = _shingles(data)
        if not found:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        level = level_of(len(found))
        worst = least_similarity(len(set(found)), window_width(level))
        if bands.probability(worst) < least:
            raise ValueError(f"{bands} find a window of similarity {worst:.2f} with {bands.probability(worst):.4f} only")
        words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        keys = np.unique(shingle_keys(words.keys()))
        minima = np.array([mixed(keys, m).min() for m in mixers(bands)], np.uint64)
        out.each.append(Template(name, set(found), level, minima))
    for level in {t.level for t in out.each}:
        mine = [k for k, t in enumerate(out.each) if t.level == level]
        table = []
        for b in range(bands.bands):
            part = np.array([_band(out.each[k].minima[b * bands.rows : (b + 1) * bands.rows, None])[0] for k in mine], np.uint64)
            order = np.argsort(part)
            table.append((part[order], np.array(mine)[order]))
        out.index[level] = table
    return out


def _band(minima: np.ndarray) -> np.ndarray:
    """(rows, n) minima to one key each."""
    key = np.zeros(minima.shape[1], np.uint64)
    for row in minima:
        key = (key ^ row) * ODD_A
    return key


def candidates(keys: np.ndarray, templates: Templates) -> np.ndarray:
    """Rows (template, first shingle, end) of windows that share a band with a template.

    ``keys`` are shingle keys of many texts end to end; a window that reaches
    into the next text is cut there by the check that follows, and every text
    starts a stride of its own only by chance, which the overlap allows for.
    """
    n = len(keys)
    found: list[np.ndarray] = []
    rows = templates.bands.rows
    held: dict[int, list[np.ndarray]] = {level: [] for level in templates.index}
    for number, mixer in enumerate(mixers(templates.bands)):
        value = mixed(keys, mixer)
        for level in range(max(templates.index, default=-1) + 1):
            if level:  # minima of blocks of 2^level from those of half the size
                if len(value) % 2:
                    value = np.append(value, np.uint64(2**64 - 1))
                value = np.minimum(value[0::2], value[1::2])
            if level not in held:
                continue
            over = np.append(value, np.full(2, 2**64 - 1, np.uint64))
            held[level].append(np.minimum(np.minimum(over[:-2], over[1:-1]), over[2:]))
            if (number + 1) % rows:
                continue
            band = _band(np.stack(held[level]))
            held[level] = []
            known, whose = templates.index[level][number // rows]
            at = np.minimum(np.searchsorted(known, band), len(known) - 1)
            for spot in np.flatnonzero(known[at] == band).tolist():
                first = spot << level
                k = int(at[spot])
                while k < len(known) and known[k] == band[spot]:
                    found.append(np.array([[whose[k], first, min(n, first + window_width(level))]]))
                    k += 1
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


FOUND = "array<struct<license: string, start: bigint, end: bigint, containment: double>>"


def _scan(batch: pa.RecordBatch, templates: Templates) -> list[list[dict]]:
    ends, raw = text_bytes(batch.column(1))
    out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    for begin, stop in pieces(ends, PIECE_BYTES):
        words = Words(raw, ends[begin : stop + 1])
        keys = shingle_keys(words.keys())
        owner = np.searchsorted(words.first, np.arange(len(keys)), side="right") - 1
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for which, first, end in candidates(keys, templates).tolist():
            # Every text that the window touches is looked at by itself.
            for row in range(int(owner[first]), int(owner[end - 1]) + 1):
                low, high = max(first, int(words.first[row])), min(end + SHINGLE - 1, int(words.first[row + 1]))
                if high - low >= SHINGLE:
                    best.setdefault((row, which), []).append((low, high))
        for (row, which), windows in best.items():
            out[begin + row] += _verified(words, int(words.first[row]), int(words.first[row + 1]), templates.each[which], windows)
    return out


def _verified(words: Words, first: int, last: int, template: Template, windows: list[tuple[int, int]]) -> list[dict]:
    """Places in one text where enough of a template's shingles stand within a window's reach of each other."""
    width = window_width(template.level)
    merged: list[list[int]] = []
    for low, high in sorted(windows):
        low, high = max(first, low - width), min(last, high + width)
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(high, merged[-1][1])
        else:
            merged.append([low, high])
    out = []
    for low, high in merged:
        text = [words.word(k) for k in range(low, high)]
        hits = [(k, s) for k in range(len(text) - SHINGLE + 1) if (s := b" ".join(text[k : k + SHINGLE])) in template.shingles]
        while hits:
            near = [h for h in hits if h[0] < hits[0][0] + width]
            share = len({s for _, s in near}) / len(template.shingles)
            if share >= CONTAINMENT:
                out.append({"license": template.name, "start": low + near[0][0] - first, "end": low + near[-1][0] + SHINGLE - first, "containment": share})
                hits = hits[len(near) :]
            else:
                hits = hits[1:]
    return out


def scan(docs: DataFrame, templates: Templates | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) for every row: licenses with the words they take up and the share of the template's shingles.

    Whole texts are scanned. Null and empty texts, and texts of fewer than five
    words, have none. Repeated rows repeat, other columns are ignored. A longer
    notice that holds a shorter one is reported as both.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(templates or prepare())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [sorted(f, key=lambda x: (x["start"], x["license"])) for f in _scan(batch, shared.value)]
                kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))
                yield pa.record_batch([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, found {FOUND}")
