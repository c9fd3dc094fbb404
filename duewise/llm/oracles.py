"""DuckDB SQL of the licence scan and of line dedup."""

from __future__ import annotations

import math

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The notices again, so that the SQL shares nothing with the operator: label, family, required words, notice.
NOTICES = """
mit-notice | mit | mit | released under the mit license
mit-text | mit | permission software | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
isc-text | mit | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
apache-2.0-notice | apache | apache 2 | licensed under the apache license version 2 0
apache-2.0-text | apache | basis | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
gpl-2.0-notice | gpl | gnu 2 | this work is licensed under the gnu general public license version 2
gpl-3.0-notice | gpl | gnu 3 | this work is licensed under the gnu general public license version 3
gpl-2.0-text | gpl | gnu 2 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-text | gpl | gnu 3 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-text | gpl | lesser | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
mpl-2.0-notice | mpl | mozilla 2 | this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
bsd-2-clause-text | bsd | redistribution binary | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause-text | bsd-names | endorse | neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
cc-by-4.0-notice | cc | cc by 4 | licensed under cc by 4 0
cc-by-sa-4.0-notice | cc | cc by sa 4 | licensed under cc by sa 4 0
cc-by-nc-4.0-notice | cc | cc by nc 4 | licensed under cc by nc 4 0
cc-by-nd-4.0-notice | cc | cc by nd 4 | licensed under cc by nd 4 0
cc-by-nc-sa-4.0-notice | cc | cc by nc sa 4 | licensed under cc by nc sa 4 0
cc0-text | cc0 | public domain | the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law
unlicense-text | unlicense | unencumbered | this is free and unencumbered software released into the public domain
all-rights-reserved | reserved | copyright rights reserved | copyright all rights reserved
"""


def licenses_sql(threshold: float = 0.8) -> str:
    rows, musts = [], []
    for label, family, required, notice in (line.split(" | ") for line in NOTICES.strip().split("\n")):
        words = sorted(set(notice.split()))
        rows += [f"('{label}', '{family}', '{w}', {len(words)}, {math.ceil(threshold * len(words) - 1e-9)})" for w in words]
        musts += [f"('{label}', '{w}', {len(required.split())})" for w in required.split()]
    return rf"""WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{WORD}') AS w FROM low),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM w),
y AS (SELECT doc_id, i, word, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS w2, lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w3 FROM x),
h AS (SELECT doc_id, i, CASE word WHEN 'general' THEN 'gpl' ELSE word END AS label FROM y WHERE (word IN ('mit', 'apache') AND w2 = 'license') OR (word = 'general' AND w2 = 'public' AND w3 = 'license')),
b AS (SELECT DISTINCT doc_id, block FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS block FROM low UNION ALL SELECT doc_id, unnest(regexp_split_to_array(t, '\n[ \t\r]*\n')) AS block FROM low)),
bw AS (SELECT DISTINCT doc_id, block, unnest(regexp_extract_all(block, '{WORD}')) AS word FROM b),
tw(label, family, word, n, need) AS (VALUES {', '.join(rows)}),
must(label, word, n) AS (VALUES {', '.join(musts)}),
has AS (SELECT doc_id, block, label FROM bw JOIN must ON bw.word = must.word GROUP BY doc_id, block, label HAVING count(*) = max(must.n)),
every_m AS (SELECT doc_id, block, label, family, CAST(count(*) AS DOUBLE) / max(n) AS share, max(n) AS n FROM bw JOIN tw ON bw.word = tw.word GROUP BY doc_id, block, label, family HAVING count(*) >= max(need)),
m AS (SELECT doc_id, block, label, share FROM every_m SEMI JOIN has USING (doc_id, block, label) QUALIFY row_number() OVER (PARTITION BY doc_id, block, family ORDER BY share DESC, n DESC, label DESC) = 1),
best AS (SELECT doc_id, label, max(share) AS share FROM m GROUP BY doc_id, label),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM best) GROUP BY doc_id),
top AS (SELECT doc_id, max(share) AS share FROM best GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN every ON every.doc_id = w.doc_id LEFT JOIN top ON top.doc_id = w.doc_id"""


#: Line dedup; documents must have distinct doc_ids (SQL has no order for rows alike).
LINES = """WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, CAST(doc_id AS HUGEINT) * 100000000 + pos AS place, line FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts)),
d AS (SELECT line, min(place) AS place, len(string_split(line, ' ')) AS n, string_split(line, ' ') AS w, length(line) AS c FROM l WHERE trim(line) <> '' GROUP BY line),
i AS (SELECT line, place, n, w, unnest(range(n)) AS i FROM d WHERE n >= 5),
v AS (SELECT line, place, n, i, array_to_string(w[:i] || w[i + 2:], ' ') AS rest FROM i),
j AS (SELECT line, place, c, unnest(range(c)) AS i FROM d WHERE n < 5 AND c >= 5),
u AS (SELECT line, place, c, i, substr(line, 1, i) || substr(line, i + 2) AS rest FROM j),
pairs AS (
  SELECT line, place, min(place) OVER (PARTITION BY n, i, rest) AS other, NULL AS shorter FROM v
  UNION ALL SELECT line, place, min(place) OVER (PARTITION BY c, i, rest), NULL FROM u
  UNION ALL SELECT v.line, v.place, d.place, d.line FROM v JOIN d ON d.line = v.rest AND d.n = v.n - 1
  UNION ALL SELECT u.line, u.place, d.place, d.line FROM u JOIN d ON d.line = u.rest AND d.n < 5),
near AS (SELECT line FROM pairs WHERE other < place UNION SELECT shorter FROM pairs WHERE shorter IS NOT NULL AND place < other),
marked AS (SELECT l.doc_id, l.place, l.line, trim(l.line) <> '' AND l.line IN (SELECT line FROM near) AS is_near, trim(l.line) <> '' AND l.place > d.place AS again FROM l LEFT JOIN d ON d.line = l.line),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) FILTER (NOT (is_near OR coalesce(again, false))) AS text, count(*) FILTER (is_near OR coalesce(again, false)) AS n_dropped, count(*) FILTER (is_near) AS n_near FROM marked GROUP BY doc_id)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(len(p.ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped, CAST(coalesce(n_near, 0) AS INTEGER) AS n_near
FROM parts p LEFT JOIN kept ON kept.doc_id = p.doc_id"""
