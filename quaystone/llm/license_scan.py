"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Words are runs of letters and digits, lower-cased (punctuation is white space), shingles five words. Templates are put
into size classes (1, 2, 4, ... shingles). For class m a text is cut into blocks of m shingles, and every two blocks
in a row are a window; so a template of the class that stands in the text lies within one window. Each window and each
template has the least value under a number of universal hashes, and a window retrieves the templates that agree with
it in at least one band (one hash each). A template with 75 % of its shingles in a window has a similarity of at least
0.75 (m/2 + 1) / (2m + m/2 + 1), over 0.15, so 64 bands miss it with a probability below (1 - 0.15)^64 < 4e-5.

A match is verified on the shingles themselves: at least 75 % of the template's distinct shingles in the two windows
around it. From each of them on the shortest stretch that holds so many is taken, and goes on over further shingles of
the template until one comes back, which belongs to the next copy; so words put into a copy don't hide it. Reported is
the span of words of a stretch; of spans of one template that overlap the fullest stands, then the one in the
template's order, then the shortest.

Cases: null and empty texts and those of fewer than five words hold nothing; repeated documents each get their rows;
templates of fewer than five words are refused; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quaystone.llm.common import as_bytes, map_batches, table
from quaystone.llm.shingles import WIDTH, windows

BANDS, CONTAINED_PCT = 64, 75
_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PUNCTUATION = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))

# Notices and opening passages of public licenses.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def license_words(text: bytes) -> list[bytes]:
    return text.lower().translate(_PUNCTUATION).split()


def chance(similarity: float, bands: int = BANDS) -> float:
    """The probability that a window and a template of this similarity share a band."""
    return 1 - (1 - similarity) ** bands


@cache
def _classes(templates: tuple[tuple[str, str], ...]):
    """By class size: names, sorted distinct shingles, places of all shingles by value and minima of its templates."""
    out: dict[int, list] = {}
    for name, text in templates:
        words = license_words(text.encode())
        if len(words) < WIDTH:
            raise ValueError(f"{name} has fewer than {WIDTH} words")
        every = windows(words)
        s, at = np.unique(every), {}
        for i, x in enumerate(every.tolist()):
            at.setdefault(x, []).append(i)
        out.setdefault(1 << (len(words) - WIDTH).bit_length(), []).append((name, s, at, (s * _A[:, None]).min(axis=1)))
    return dict(sorted(out.items()))


def stretches(place: list[int], values: list[int], at: dict[int, list[int]]) -> list[tuple[int, int, int, int]]:
    """(distinct shingles, steps back in the template, first place, last place) of the stretch from each place that holds enough."""
    out = []
    for s in range(len(place)):
        seen: dict[int, int] = {}
        back, last = 0, -1
        for e in range(s, len(place)):
            v = values[e]
            times = seen.get(v, 0)
            if times >= len(at[v]) and 100 * len(seen) >= CONTAINED_PCT * len(at):
                e -= 1
                break
            seen[v] = times + 1
            now = at[v][min(times, len(at[v]) - 1)]
            back, last = back + (now < last), now
        if 100 * len(seen) < CONTAINED_PCT * len(at):
            break  # nor from any later place
        out.append((len(seen), back, place[s], place[e]))
    return out


def find(words: list[bytes], templates=tuple(TEMPLATES.items())) -> list[tuple[str, int, int, int, int]]:
    """(template, first word, end, shingles found, shingles of the template), by place."""
    if len(words) < WIDTH:
        return []
    shingles, classes, out = windows(words), _classes(templates), []
    hits: dict[tuple[str, int], list] = {}
    for at in range(0, len(shingles), 1 << 14):  # long texts in parts, which overlap by the largest window
        part = shingles[at : at + (1 << 14) + 4 * max(classes)]
        hashed = part * _A[:, None]
        for m, members in classes.items():
            blocks = np.minimum.reduceat(hashed, np.arange(0, len(part), m), axis=1) if m > 1 else hashed
            mins = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
            for name, own, own_at, least in members:
                for b in np.flatnonzero((mins == least[:, None]).any(axis=0)):
                    low, high = max(0, at + (int(b) - 1) * m), at + (int(b) + 3) * m
                    near = shingles[low:high]
                    place = np.flatnonzero(np.isin(near, own))
                    if 100 * len(place) < CONTAINED_PCT * len(own):
                        continue
                    for n, back, first, last in stretches(place.tolist(), near[place].tolist(), own_at):
                        hits.setdefault((name, len(own)), []).append((n, back, low + first, low + last + WIDTH))
    for (name, size), spans in hits.items():
        kept: list = []
        for n, _, a, b in sorted(set(spans), key=lambda x: (-x[0], x[1], x[3] - x[2], x[2])):
            if all(b <= c or a >= d for _, c, d in kept):
                kept.append((n, a, b))
        out += [(name, a, b, n, size) for n, a, b in kept]
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, first_word, end_word, n_found and n_template, a row per verified match."""
    chosen = tuple((templates or TEMPLATES).items())

    def run(cols):
        rows = [(i, *hit) for i, text in zip(cols[0], cols[1], strict=True) for hit in find(license_words(text), chosen)]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6

    return map_batches(as_bytes(docs, "doc_id"), run, "doc_id long, license string, first_word long, end_word long, n_found long, n_template long")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}
SQL: dict[str, str] = {}
