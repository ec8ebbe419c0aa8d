"""Meters as literal SQL: what the queries over patterns are checked against, apart from the code that makes patterns."""

from __future__ import annotations

# Patterns of feet in all their forms.
FORMS = """form(foot, form, pattern) AS (VALUES
    ('Fawlon', 'None', '11010'), ('Fawlon', 'Qabadh', '1101'), ('Fawlon', 'Thalm', '1010'), ('Fawlon', 'Tharm', '101'), ('Fawlon', 'Batr', '10'), ('Fawlon', 'Hadhf', '110'),
    ('Fawlon', 'Qataa', '1100'), ('Faelon', 'None', '10110'), ('Faelon', 'Khaban', '1110'), ('Faelon', 'Tasheeth', '1010'), ('Faelon', 'Qataa', '1010'),
    ('Faelon', 'TarfeelAndKhaban', '111010'), ('Faelon', 'Tatheel', '101100'), ('Mafaeelon', 'None', '1101010'), ('Mafaeelon', 'Qabadh', '110110'), ('Mafaeelon', 'Kaff', '110101'),
    ('Mafaeelon', 'Hadhf', '11010'), ('Mustafelon', 'None', '1010110'), ('Mustafelon', 'Khaban', '110110'), ('Mustafelon', 'Tay', '101110'), ('Mustafelon', 'Khabal', '11110'),
    ('Mustafelon', 'KhabanAndQataa', '11010'), ('Mustafelon', 'Qataa', '101010'), ('Mustafelon', 'Tatheel', '10101100'), ('Mutafaelon', 'None', '1110110'),
    ('Mutafaelon', 'Edmaar', '1010110'), ('Mutafaelon', 'Waqas', '110110'), ('Mutafaelon', 'Khazal', '101110'), ('Mutafaelon', 'Hathath', '1110'),
    ('Mutafaelon', 'HathathAndEdmaar', '1010'), ('Mutafaelon', 'Qataa', '111010'), ('Mutafaelon', 'QataaAndEdmaar', '101010'), ('Mutafaelon', 'Tarfeel', '111011010'),
    ('Mutafaelon', 'TarfeelAndEdmaar', '101011010'), ('Mutafaelon', 'Tatheel', '11101100'), ('Mutafaelon', 'TatheelAndEdmaar', '10101100'), ('Mafaelaton', 'None', '1101110'),
    ('Mafaelaton', 'Asab', '1101010'), ('Mafaelaton', 'Qataf', '11010'), ('Mafoolato', 'None', '1010101'), ('Mafoolato', 'Khaban', '110101'), ('Mafoolato', 'Tay', '101101'),
    ('Mafoolato', 'Khabal', '11101'), ('Mafoolato', 'Kasf', '101010'), ('Mafoolato', 'KhabalAndKasf', '1110'), ('Mafoolato', 'Salam', '1010'), ('Mafoolato', 'TayAndKasf', '10110'),
    ('Mafoolato', 'Waqf', '1010100'), ('Mafoolato', 'WaqfAndTay', '101100'), ('Fae_laton', 'None', '1011010'), ('Fae_laton', 'Kaff', '101101'), ('Mustafe_lon', 'None', '1010110'),
    ('Mustafe_lon', 'Khaban', '110110'), ('Mustafe_lon', 'Kaff', '101011'), ('Mustafe_lon', 'KhabanAndQataa', '11010'), ('Faelaton', 'None', '1011010'),
    ('Faelaton', 'Khaban', '111010'), ('Faelaton', 'Kaff', '101101'), ('Faelaton', 'Shakal', '11101'), ('Faelaton', 'Tasheeth', '101010'), ('Faelaton', 'Hadhf', '10110'),
    ('Faelaton', 'HadhfAndKhaban', '1110'), ('Faelaton', 'KhabanAndQataa', '11100'), ('Faelaton', 'Qataa', '101100'), ('Faelaton', 'Tasbeegh', '10110100')
)"""
# Forms that a foot may have before the last one of a half, in order.
INNER = """inner_form(foot, forms) AS (VALUES
    ('Fawlon', ['None', 'Qabadh', 'Thalm', 'Tharm']), ('Faelon', ['None', 'Khaban', 'Tasheeth']), ('Mafaeelon', ['None', 'Qabadh', 'Kaff']),
    ('Mustafelon', ['None', 'Khaban', 'Tay', 'Khabal']), ('Mutafaelon', ['None', 'Edmaar', 'Waqas', 'Khazal']), ('Mafaelaton', ['None', 'Asab']),
    ('Mafoolato', ['None', 'Khaban', 'Tay', 'Khabal']), ('Fae_laton', ['None', 'Kaff']), ('Mustafe_lon', ['None', 'Khaban', 'Kaff']),
    ('Faelaton', ['None', 'Khaban', 'Kaff', 'Shakal', 'Tasheeth'])
)"""
# Feet of a half, by meter, with the meter that it is a part of.
FEET_OF = """feet_of(meter_no, meter, feet, parent) AS (VALUES
    (1, 'Taweel', ['Fawlon', 'Mafaeelon', 'Fawlon', 'Mafaeelon'], 'Taweel'), (2, 'Madeed', ['Faelaton', 'Faelon', 'Faelaton'], 'Madeed'),
    (3, 'BaseetMajzoo', ['Mustafelon', 'Faelon', 'Mustafelon'], 'Baseet'), (4, 'BaseetMukhalla', ['Mustafelon', 'Faelon', 'Mustafelon'], 'Baseet'),
    (5, 'Baseet', ['Mustafelon', 'Faelon', 'Mustafelon', 'Faelon'], 'Baseet'), (6, 'WaferMajzoo', ['Mafaelaton', 'Mafaelaton'], 'Wafer'),
    (7, 'Wafer', ['Mafaelaton', 'Mafaelaton', 'Mafaelaton'], 'Wafer'), (8, 'KamelMajzoo', ['Mutafaelon', 'Mutafaelon'], 'Kamel'),
    (9, 'Kamel', ['Mutafaelon', 'Mutafaelon', 'Mutafaelon'], 'Kamel'), (10, 'Hazaj', ['Mafaeelon', 'Mafaeelon'], 'Hazaj'),
    (11, 'RajazManhook', ['Mustafelon', 'Mustafelon'], 'Rajaz'), (12, 'RajazMashtoor', ['Mustafelon', 'Mustafelon', 'Mustafelon'], 'Rajaz'),
    (13, 'RajazMajzoo', ['Mustafelon', 'Mustafelon'], 'Rajaz'), (14, 'Rajaz', ['Mustafelon', 'Mustafelon', 'Mustafelon'], 'Rajaz'),
    (15, 'RamalMajzoo', ['Faelaton', 'Faelaton'], 'Ramal'), (16, 'Ramal', ['Faelaton', 'Faelaton', 'Faelaton'], 'Ramal'),
    (17, 'SareeMashtoor', ['Mustafelon', 'Mustafelon', 'Mafoolato'], 'Saree'), (18, 'Saree', ['Mustafelon', 'Mustafelon', 'Mafoolato'], 'Saree'),
    (19, 'MunsarehManhook', ['Mustafelon', 'Mafoolato'], 'Munsareh'), (20, 'Munsareh', ['Mustafelon', 'Mafoolato', 'Mustafelon'], 'Munsareh'),
    (21, 'KhafeefMajzoo', ['Faelaton', 'Mustafe_lon'], 'Khafeef'), (22, 'Khafeef', ['Faelaton', 'Mustafe_lon', 'Faelaton'], 'Khafeef'),
    (23, 'Mudhare', ['Mafaeelon', 'Fae_laton'], 'Mudhare'), (24, 'Muqtadheb', ['Mafoolato', 'Mustafelon'], 'Muqtadheb'), (25, 'Mujtath', ['Mustafe_lon', 'Faelaton'], 'Mujtath'),
    (26, 'MutakarebMajzoo', ['Fawlon', 'Fawlon', 'Fawlon'], 'Mutakareb'), (27, 'Mutakareb', ['Fawlon', 'Fawlon', 'Fawlon', 'Fawlon'], 'Mutakareb'),
    (28, 'MutadarakMashtoor', ['Faelon', 'Faelon', 'Faelon'], 'Mutadarak'), (29, 'MutadarakMajzoo', ['Faelon', 'Faelon', 'Faelon'], 'Mutadarak'),
    (30, 'Mutadarak', ['Faelon', 'Faelon', 'Faelon', 'Faelon'], 'Mutadarak')
)"""
# Endings of the first half with those of the second; "one" where a line is one half.
ENDINGS = """endings(meter, ending_no, ending, seconds) AS (VALUES
    ('Taweel', 1, 'Qabadh', ['Qabadh', 'Hadhf', 'None']), ('Madeed', 1, 'None', ['None']), ('Madeed', 2, 'Hadhf', ['Qataa']), ('Madeed', 3, 'HadhfAndKhaban', ['HadhfAndKhaban']),
    ('BaseetMajzoo', 1, 'None', ['None', 'Tatheel', 'Qataa']), ('BaseetMajzoo', 2, 'Qataa', ['None']), ('BaseetMukhalla', 1, 'KhabanAndQataa', ['KhabanAndQataa']),
    ('Baseet', 1, 'Khaban', ['Khaban', 'Qataa']), ('WaferMajzoo', 1, 'None', ['None', 'Asab']), ('WaferMajzoo', 2, 'Asab', ['None', 'Asab']), ('Wafer', 1, 'Qataf', ['Qataf']),
    ('KamelMajzoo', 1, 'None', ['None', 'Edmaar', 'Qataa', 'QataaAndEdmaar', 'Tatheel', 'TatheelAndEdmaar', 'Tarfeel', 'TarfeelAndEdmaar']),
    ('KamelMajzoo', 2, 'Edmaar', ['None', 'Edmaar', 'Qataa', 'QataaAndEdmaar', 'Tatheel', 'TatheelAndEdmaar', 'Tarfeel', 'TarfeelAndEdmaar']),
    ('Kamel', 1, 'None', ['None', 'Edmaar', 'Qataa', 'QataaAndEdmaar', 'HathathAndEdmaar']),
    ('Kamel', 2, 'Edmaar', ['None', 'Edmaar', 'Qataa', 'QataaAndEdmaar', 'HathathAndEdmaar']), ('Kamel', 3, 'Hathath', ['Hathath', 'HathathAndEdmaar']),
    ('Hazaj', 1, 'None', ['None', 'Hadhf']), ('Hazaj', 2, 'Kaff', ['None', 'Hadhf']), ('RajazManhook', 1, 'one', ['None', 'Khaban', 'Tay', 'Khabal', 'Qataa', 'KhabanAndQataa']),
    ('RajazMashtoor', 1, 'one', ['None', 'Khaban', 'Tay', 'Khabal', 'Qataa', 'KhabanAndQataa']), ('RajazMajzoo', 1, 'None', ['None', 'Khaban', 'Tay', 'Khabal']),
    ('RajazMajzoo', 2, 'Khaban', ['None', 'Khaban', 'Tay', 'Khabal']), ('RajazMajzoo', 3, 'Tay', ['None', 'Khaban', 'Tay', 'Khabal']),
    ('RajazMajzoo', 4, 'Khabal', ['None', 'Khaban', 'Tay', 'Khabal']), ('Rajaz', 1, 'None', ['None', 'Khaban', 'Tay', 'Khabal', 'Qataa', 'KhabanAndQataa']),
    ('Rajaz', 2, 'Khaban', ['None', 'Khaban', 'Tay', 'Khabal', 'Qataa', 'KhabanAndQataa']), ('Rajaz', 3, 'Tay', ['None', 'Khaban', 'Tay', 'Khabal', 'Qataa', 'KhabanAndQataa']),
    ('Rajaz', 4, 'Khabal', ['None', 'Khaban', 'Tay', 'Khabal', 'Qataa', 'KhabanAndQataa']), ('RamalMajzoo', 1, 'None', ['None', 'Khaban', 'Tasbeegh', 'Hadhf', 'HadhfAndKhaban']),
    ('RamalMajzoo', 2, 'Khaban', ['None', 'Khaban', 'Tasbeegh', 'Hadhf', 'HadhfAndKhaban']),
    ('Ramal', 1, 'Hadhf', ['None', 'Khaban', 'Hadhf', 'HadhfAndKhaban', 'Qataa', 'KhabanAndQataa']),
    ('Ramal', 2, 'HadhfAndKhaban', ['None', 'Khaban', 'Hadhf', 'HadhfAndKhaban', 'Qataa', 'KhabanAndQataa']), ('SareeMashtoor', 1, 'one', ['Waqf', 'Kasf']),
    ('Saree', 1, 'TayAndKasf', ['TayAndKasf', 'Salam', 'WaqfAndTay']), ('Saree', 2, 'KhabalAndKasf', ['KhabalAndKasf', 'Salam']), ('MunsarehManhook', 1, 'one', ['Waqf', 'Kasf']),
    ('Munsareh', 1, 'Tay', ['Tay', 'Qataa']), ('KhafeefMajzoo', 1, 'None', ['None', 'KhabanAndQataa']), ('KhafeefMajzoo', 2, 'Khaban', ['Khaban']),
    ('Khafeef', 1, 'None', ['None', 'Tasheeth', 'Hadhf', 'HadhfAndKhaban']), ('Khafeef', 2, 'Khaban', ['None', 'Tasheeth', 'Hadhf', 'HadhfAndKhaban']),
    ('Mudhare', 1, 'None', ['None']), ('Muqtadheb', 1, 'Tay', ['Tay']), ('Mujtath', 1, 'None', ['None', 'Khaban', 'Tasheeth']),
    ('Mujtath', 2, 'Khaban', ['None', 'Khaban', 'Tasheeth']), ('MutakarebMajzoo', 1, 'Hadhf', ['Hadhf', 'Batr']), ('Mutakareb', 1, 'None', ['None', 'Hadhf', 'Qataa', 'Batr']),
    ('Mutakareb', 2, 'Qabadh', ['None', 'Hadhf', 'Qataa', 'Batr']), ('Mutakareb', 3, 'Hadhf', ['None', 'Hadhf', 'Qataa', 'Batr']),
    ('MutadarakMashtoor', 1, 'one', ['None', 'Khaban', 'Tasheeth', 'Tatheel', 'TarfeelAndKhaban']),
    ('MutadarakMajzoo', 1, 'None', ['None', 'Khaban', 'Tasheeth', 'Tatheel', 'TarfeelAndKhaban']),
    ('MutadarakMajzoo', 2, 'Khaban', ['None', 'Khaban', 'Tasheeth', 'Tatheel', 'TarfeelAndKhaban']),
    ('MutadarakMajzoo', 3, 'Tasheeth', ['None', 'Khaban', 'Tasheeth', 'Tatheel', 'TarfeelAndKhaban']), ('Mutadarak', 1, 'None', ['None', 'Khaban', 'Tasheeth']),
    ('Mutadarak', 2, 'Khaban', ['None', 'Khaban', 'Tasheeth']), ('Mutadarak', 3, 'Tasheeth', ['None', 'Khaban', 'Tasheeth'])
)"""
# Forms that a meter bars, by half and place.
BARRED = """barred(meter, half, place, forms) AS (VALUES
    ('Taweel', 0, 3, ['Thalm', 'Tharm']), ('Taweel', 1, 1, ['Thalm', 'Tharm']), ('Taweel', 1, 3, ['Thalm', 'Tharm']), ('Madeed', 0, 1, ['Shakal', 'Tasheeth']),
    ('Madeed', 0, 2, ['Tasheeth']), ('Madeed', 1, 1, ['Shakal', 'Tasheeth']), ('Madeed', 1, 2, ['Tasheeth']), ('BaseetMajzoo', 0, 2, ['Tasheeth']),
    ('BaseetMajzoo', 1, 2, ['Tasheeth']), ('BaseetMukhalla', 0, 2, ['Tasheeth']), ('BaseetMukhalla', 1, 2, ['Tasheeth']), ('Baseet', 0, 2, ['Tasheeth']),
    ('Baseet', 1, 2, ['Tasheeth']), ('Hazaj', 0, 1, ['Qabadh']), ('Hazaj', 1, 1, ['Qabadh']), ('RamalMajzoo', 0, 1, ['Tasheeth']), ('RamalMajzoo', 1, 1, ['Tasheeth']),
    ('Ramal', 0, 1, ['Tasheeth']), ('Ramal', 0, 2, ['Tasheeth']), ('Ramal', 1, 1, ['Tasheeth']), ('Ramal', 1, 2, ['Tasheeth']),
    ('KhafeefMajzoo', 0, 1, ['Kaff', 'Shakal', 'Tasheeth']), ('KhafeefMajzoo', 1, 1, ['Kaff', 'Shakal', 'Tasheeth']), ('Khafeef', 0, 1, ['Kaff', 'Shakal']),
    ('Khafeef', 1, 1, ['Kaff', 'Shakal']), ('Muqtadheb', 0, 1, ['Khabal']), ('Muqtadheb', 1, 1, ['Khabal']), ('Mujtath', 0, 1, ['Kaff']), ('Mujtath', 1, 1, ['Kaff']),
    ('MutakarebMajzoo', 0, 2, ['Thalm', 'Tharm']), ('MutakarebMajzoo', 1, 1, ['Thalm', 'Tharm']), ('MutakarebMajzoo', 1, 2, ['Thalm', 'Tharm']),
    ('Mutakareb', 0, 2, ['Thalm', 'Tharm']), ('Mutakareb', 0, 3, ['Thalm', 'Tharm']), ('Mutakareb', 1, 1, ['Thalm', 'Tharm']), ('Mutakareb', 1, 2, ['Thalm', 'Tharm']),
    ('Mutakareb', 1, 3, ['Thalm', 'Tharm'])
)"""

#: Half lines: every choice of forms for the feet before the last one, and of an ending.
_HALF_LINES = """choices AS (
  SELECT meter_no, meter, feet, 0 AS half, ending_no, ending, list_distinct(CASE WHEN ending = 'one' THEN seconds ELSE [ending] || seconds END) AS lasts, CASE WHEN ending = 'one' THEN seconds ELSE [ending] || seconds END AS ordered FROM feet_of JOIN endings USING (meter)
  UNION ALL SELECT meter_no, meter, feet, 1, ending_no, ending, list_distinct(seconds), seconds FROM feet_of JOIN endings USING (meter) WHERE ending <> 'one'
), places AS (
  SELECT c.*, form, CASE WHEN c.place < len(c.feet) THEN list_position(i.forms, form) ELSE list_position(ordered, form) END AS nth, f.pattern
  FROM (SELECT *, unnest(range(1, len(feet) + 1)) AS place, unnest(feet) AS foot FROM choices) c
  JOIN inner_form i USING (foot) JOIN form f USING (foot) LEFT JOIN barred b ON b.meter = c.meter AND b.half = c.half AND b.place = c.place
  WHERE CASE WHEN c.place < len(c.feet) THEN list_contains(i.forms, form) AND NOT coalesce(list_contains(b.forms, form), false) ELSE list_contains(lasts, form) END
), one AS (SELECT * FROM places WHERE place = 1), two AS (SELECT * FROM places WHERE place = 2), three AS (SELECT * FROM places WHERE place = 3), four AS (SELECT * FROM places WHERE place = 4),
half_lines AS (
  SELECT a.meter_no, meter, a.ending_no, ending, half, [a.nth, coalesce(b.nth, 0), coalesce(c.nth, 0), coalesce(d.nth, 0)] AS nth, a.pattern || coalesce(b.pattern, '') || coalesce(c.pattern, '') || coalesce(d.pattern, '') AS pattern,
    concat_ws(' ', a.foot || ':' || a.form, b.foot || ':' || b.form, c.foot || ':' || c.form, d.foot || ':' || d.form) AS feet
  FROM one a LEFT JOIN two b USING (meter, ending, half) LEFT JOIN three c USING (meter, ending, half) LEFT JOIN four d USING (meter, ending, half)
  WHERE NOT (meter = 'Madeed' AND a.form = 'Kaff' AND b.form = 'Khaban') AND NOT (meter = 'Mudhare' AND a.form = 'None')
)"""
#: Whole lines with the feet of their first combination, under their meter and the one it is a part of.
_WHOLE_LINES = """whole AS (
  SELECT a.meter, [a.meter_no, a.ending_no] || a.nth || b.nth AS nth, a.pattern || b.pattern AS beat, a.feet || '#' || b.feet AS feet FROM half_lines a JOIN half_lines b ON a.meter = b.meter AND a.ending = b.ending AND a.half = 0 AND b.half = 1
  UNION ALL SELECT meter, [meter_no, ending_no] || nth, pattern, feet FROM half_lines WHERE ending = 'one'
), under AS (SELECT DISTINCT meter, unnest([meter, parent]) AS of FROM feet_of),
line_feet AS (SELECT of AS meter, beat, arg_min(feet, nth) AS feet FROM whole JOIN under USING (meter) GROUP BY of, beat)"""
HALVES = f"{FORMS}, {INNER}, {FEET_OF}, {ENDINGS}, {BARRED}, {_HALF_LINES}, halves AS (SELECT DISTINCT meter, pattern FROM half_lines WHERE half = 0)"
LINES = f"{HALVES}, {_WHOLE_LINES}"
FEET = f"{FORMS}, {INNER}, feet AS (SELECT foot, form, pattern FROM form JOIN inner_form USING (foot) WHERE list_contains(forms, form))"
