"""DuckDB equivalents of the queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Labels by what the accepted wording is in words with one space around each.
_TEMPLATES = [
    ("apache", " licensed under the apache license version 2 0 "),
    ("bsd", " redistribution and use in source and binary forms with or without modification are permitted "),
    ("cc-by", " licensed under (a )?creative commons attribution ([^ ]+ ){1,2}international license "),
    ("cc-by-nc", " licensed under cc by nc [^ ]+ "),
    ("gpl", " licensed under the gnu general public license "),
    ("gpl", " this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "),
    ("isc", " permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted "),
    ("mit", " under the mit license "),
    ("mit", " permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "),
    ("mpl", " this source code form is subject to the terms of the mozilla public license v 2 0 "),
]
_LABELS = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{label}' END" for label, p in _TEMPLATES)
_BASE = ", ".join(f"CASE WHEN len({v}) > 0 THEN '{label}' END" for v, label in (("m", "mit"), ("a", "apache"), ("g", "gpl")))

LICENSES = rf"""WITH x AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
  p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m, list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a,
    list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g FROM x),
  q AS (SELECT *, list_concat(m, a, g) AS places, list_sort(list_filter([{_BASE}], lambda l: l IS NOT NULL)) AS base, list_filter([{_LABELS}], lambda l: l IS NOT NULL) AS own FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels, CAST(CASE WHEN len(own) > 0 THEN 1 WHEN len(places) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM q"""

NGRAM_JOIN = rf"""WITH RECURSIVE x AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM x),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
  l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id FROM documents d JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
