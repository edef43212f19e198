"""License scans by conditional compression: a block that a license text helps to compress is likely of that license."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import utf8

# License notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "MIT": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
}
WORD = re.compile(r"[A-Za-z0-9.+-]*[A-Za-z0-9]")
SCHEMA = "array<struct<license:string,start:int,end:int,wording:string,saved:int>>"


class Notice:
    """A template's words, how many may differ, and a compressor whose raw dictionary they are, with single spaces as in blocks."""

    def __init__(self, name: str, text: str, tolerance: float) -> None:
        import zstandard

        self.name, self.words = name, [w.lower() for w in WORD.findall(text)]
        own = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.slack = int(tolerance * len(self.words))
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=False, write_dict_id=False).compress

    def pieces(self) -> list[tuple[int, list[str]]]:
        """Places and words of slack + 1 pieces: where at most slack words differ, one of them stands unchanged."""
        ends = [round(k * len(self.words) / (self.slack + 1)) for k in range(self.slack + 2)]
        return [(a, self.words[a:b]) for a, b in zip(ends, ends[1:], strict=False) if a < b]

    def differences(self, own: list[str], start: int) -> tuple[int, int, str] | None:
        """The place near word start where the notice stands, and its differences (-word and +word), if few enough and none of a word with digits."""
        if start >= 0 and own[start : start + len(self.words)] == self.words:
            return start, start + len(self.words), ""
        # fewest words changed, left out or added, with the words before and after the notice free
        low = max(0, start - self.slack)
        window, far = own[low : max(0, start + len(self.words) + self.slack)], len(self.words) + 1
        cost = [[0] * (len(window) + 1)]
        for i, w in enumerate(self.words):
            above, row = cost[-1], [i + 1]
            for j, x in enumerate(window):
                inside = abs(start - low + i - j) <= 2 * self.slack + 1
                row.append(min(above[j] + (w != x), above[j + 1] + 1, row[j] + 1) if inside else far)
            cost.append(row)
        end = min(range(len(window) + 1), key=lambda j: (cost[-1][j], j == 0 or window[j - 1] != self.words[-1]))
        if cost[-1][end] > self.slack:
            return None
        i, j, odd = len(self.words), end, []
        while i:  # among equals, words that agree, then words of the text that are added
            here, w = cost[i][j], self.words[i - 1]
            same = j > 0 and w == window[j - 1]
            if j and here == cost[i][j - 1] + 1 and not same:
                j -= 1
                odd.append(("+", window[j]))
            elif j and here == cost[i - 1][j - 1] + (not same):
                i, j = i - 1, j - 1
                odd += [] if same else [("+", window[j]), ("-", w)]
            elif here == cost[i - 1][j] + 1:
                i -= 1
                odd.append(("-", w))
            else:
                j -= 1
                odd.append(("+", window[j]))
        if j == end or any(re.search(r"\d", w) for _, w in odd):
            return None
        return low + j, low + end, " ".join(sign + w for sign, w in reversed(odd))


class Scanner:
    """Finds the notices of texts.

    Candidates come from the notices' own words: a text is looked at where a piece
    of a notice stands unchanged, one of so many that every place with few enough
    differences has one. An automaton of the pieces' longest words leaves out
    other texts.
    """

    def __init__(self, templates: dict[str, list[str]], tolerance: float) -> None:
        import ahocorasick
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
        self.notices = [n for name, texts in templates.items() for text in texts if (n := Notice(name, text, tolerance)).words]
        self.pieces: dict[str, list[tuple[int, int, list[str]]]] = {}
        self.anchors = ahocorasick.Automaton()
        for k, notice in enumerate(self.notices):
            for at, words in notice.pieces():
                self.pieces.setdefault(words[0], []).append((k, at, words))
                self.anchors.add_word(max(words, key=len), 1)
        self.anchors.make_automaton()

    def __call__(self, text: str) -> list[dict]:
        if not len(self.anchors) or next(self.anchors.iter(text.lower()), None) is None:
            return []
        words = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
        own = [w for w, _, _ in words]
        hits = sorted({(j - at, k) for j, w in enumerate(own) for k, at, piece in self.pieces.get(w, ()) if own[j : j + len(piece)] == piece})
        out, low = [], 0
        while low < len(hits):  # hits whose places overlap share a block
            first, last, high = len(own), 0, low
            while high < len(hits) and (high == low or hits[high][0] - self.notices[hits[high][1]].slack < last):
                at, notice = hits[high][0], self.notices[hits[high][1]]
                first, last = min(first, max(0, at - notice.slack)), max(last, min(len(own), at + len(notice.words) + notice.slack))
                high += 1
            out += self.winners(words, own, first, last, hits[low:high])
            low = high
        return sorted(out, key=lambda x: (x["start"], x["license"]))

    def winners(self, words: list[tuple[str, int, int]], own: list[str], first: int, last: int, hits: list[tuple[int, int]]) -> Iterator[dict]:
        """The block's notices: templates by the bytes that they save, each confirmed word by word where its pieces stand, and none over another."""
        block = " ".join(own[first:last]).encode()
        alone = len(self.plain(block))
        ranked = sorted((len(n.compress(block)) - alone, k) for k, n in enumerate(self.notices))
        taken: list[tuple[int, int]] = []
        for more, k in ranked:
            if more >= 0:
                return
            free = 0
            for at in (at for at, kk in hits if kk == k):
                found = self.notices[k].differences(own, at)
                if found and found[0] >= free and not any(a < found[1] and b > found[0] for a, b in taken):
                    free = found[1]
                    taken.append(found[:2])
                    yield {"license": self.notices[k].name, "start": words[found[0]][1], "end": words[found[1] - 1][2], "wording": found[2], "saved": -more}


def scanned(docs: DataFrame, *, templates: dict[str, list[str]] | None = None, tolerance: float = 0.1, text: str = "text", found: str = "licenses") -> DataFrame:
    """docs with found: license, start and end (code points), exact wording differences and bytes saved, of each notice in the whole text.

    Blocks around places where a piece of a notice stands unchanged are compressed
    alone and with every template as a raw zstandard dictionary, and templates
    that save bytes are compared word by word, best first. At most tolerance of a
    notice's words may differ, and words with digits (versions) must agree.
    Null and empty texts hold none; texts may have any length; equal texts get
    equal results, ids are not read, and an empty table gives none. Among templates
    that save as much the first named wins. A column of docs that is named like
    found is replaced.
    """
    known = templates or TEMPLATES

    @F.pandas_udf(SCHEMA)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Scanner(known, tolerance)
        for batch in batches:
            yield pd.Series([of(b.decode("utf-8", "replace")) for b in batch])

    return docs.withColumn(found, scan(utf8(text)))
