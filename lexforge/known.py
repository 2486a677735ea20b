"""Fixtures with literal results, for operators that SQL cannot express."""

from __future__ import annotations

# Words in styles, syllables parted by hyphens: (word, style, text, HTML with stress).
KNOWN_WORDS = (
    ("שָׁלוֹם", "000_simple_sefardi", "sha-lom", "sha-lom"),
    ("שָׁלוֹם", "010_simple_ashkenazi", "sho-lom", "sho-lom"),
    ("שָׁלוֹם", "060_super_simple", "SHAH-LOHM", "SHAH-LOHM"),
    ("שָׁלוֹם", "075_artscroll_sephardic", "sha-lom", "<strong>sha</strong>-<strong>lom</strong>"),
    ("שָׁלוֹם", "110_sbl_academic", "šā-lōm", "šā-lōm"),
    ("שָׁלוֹם", "120_sbl_general", "sha-lom", "sha-lom"),
    ("שָׁלוֹם", "130_brill", "sha-lom", "sha-lom"),
    ("שָׁלוֹם", "140_ipa", "ʃaː-ˈloːm", "ʃaː-ˈloːm"),
    ("שָׁלוֹם", "150_iso_259_2", "šā-lōm", "šā-lōm"),
    ("שָׁלוֹם", "210_spanish", "sha-lóm", "sha-lóm"),
    ("שָׁלוֹם", "220_german", "scha-lom", "scha-lom"),
    ("שָׁלוֹם", "230_russian", "ша-ло́м", "ша-ло́м"),
    ("שָׁלוֹם", "240_finnish", "ša-lom", "ša-lom"),
    ("שָׁלוֹם", "310_braille", "%<LOM", "%&lt;LOM"),
    ("שָׁלוֹם", "070_artscroll", "sho-lom", "sho-lom"),
    ("בְּרֵאשִׁית", "000_simple_sefardi", "be-re-shit", "be-re-shit"),
    ("בְּרֵאשִׁית", "010_simple_ashkenazi", "be-re-shis", "be-re-shis"),
    ("בְּרֵאשִׁית", "110_sbl_academic", "bə-rēʾ-šit̲", "bə-rēʾ-šit̲"),
    ("אֱלֹהִים", "000_simple_sefardi", "e-lo-him", "e-lo-him"),
    ("אֱלֹהִים", "010_simple_ashkenazi", "e-lo-him", "e-lo-him"),
    ("אֱלֹהִים", "110_sbl_academic", "ʾĕ-lō-him", "ʾĕ-lō-him"),
    ("הָאָרֶץ", "000_simple_sefardi", "ha-'a-retz", "ha-<strong>'a</strong>-retz"),
    ("הָאָרֶץ", "010_simple_ashkenazi", "ho-'o-retz", "ho-<strong>'o</strong>-retz"),
    ("הָאָרֶץ", "110_sbl_academic", "hā-ʾā-reṣ", "hā-<strong>ʾā</strong>-reṣ"),
    ("מֶלֶךְ", "000_simple_sefardi", "me-lech", "<strong>me</strong>-lech"),
    ("מֶלֶךְ", "075_artscroll_sephardic", "me-lech", "<strong>me</strong>-<strong>lech</strong>"),
    ("מֶלֶךְ", "140_ipa", "ˈme-leχ", "ˈme-leχ"),
    ("מֶלֶךְ", "210_spanish", "mé-lej", "mé-lej"),
    ("מֶלֶךְ", "230_russian", "ме́-лех", "ме́-лех"),
    ("מֶלֶךְ", "310_braille", "ML*", "ML*"),
    ("תּוֹרָה", "000_simple_sefardi", "to-rah", "to-rah"),
    ("תּוֹרָה", "010_simple_ashkenazi", "to-roh", "to-roh"),
    ("תּוֹרָה", "110_sbl_academic", "tō-rāh", "tō-rāh"),
    ("שַׁבָּת", "000_simple_sefardi", "shab-bat", "shab-bat"),
    ("שַׁבָּת", "010_simple_ashkenazi", "shab-bos", "shab-bos"),
    ("שַׁבָּת", "110_sbl_academic", "šab-bāt̲", "šab-bāt̲"),
    ("רוּחַ", "000_simple_sefardi", "ruach", "ruach"),
    ("רוּחַ", "010_simple_ashkenazi", "ruach", "ruach"),
    ("רוּחַ", "110_sbl_academic", "rûaḥ", "rûaḥ"),
    ("יִשְׂרָאֵל", "000_simple_sefardi", "yis-ra-'el", "yis-ra-'el"),
    ("יִשְׂרָאֵל", "010_simple_ashkenazi", "yis-ro-'el", "yis-ro-'el"),
    ("יִשְׂרָאֵל", "110_sbl_academic", "yiś-rā-ʾēl", "yiś-rā-ʾēl"),
    ("חׇכְמָה", "000_simple_sefardi", "choch-mah", "choch-mah"),
    ("חׇכְמָה", "010_simple_ashkenazi", "choch-moh", "choch-moh"),
    ("חׇכְמָה", "110_sbl_academic", "ḥok̲-māh", "ḥok̲-māh"),
    ("מִצְרַיִם", "000_simple_sefardi", "mitz-ra-yim", "mitz-<strong>ra</strong>-yim"),
    ("מִצְרַיִם", "010_simple_ashkenazi", "mitz-ra-yim", "mitz-<strong>ra</strong>-yim"),
    ("מִצְרַיִם", "110_sbl_academic", "miṣ-ra-yim", "miṣ-<strong>ra</strong>-yim"),
    ("נְבִיאִים", "000_simple_sefardi", "ne-vi-'im", "ne-vi-'im"),
    ("נְבִיאִים", "010_simple_ashkenazi", "ne-vi-'im", "ne-vi-'im"),
    ("נְבִיאִים", "110_sbl_academic", "nə-b̲i-ʾim", "nə-b̲i-ʾim"),
    ("צִיּוֹן", "000_simple_sefardi", "tziy-yon", "tziy-yon"),
    ("צִיּוֹן", "010_simple_ashkenazi", "tziy-yon", "tziy-yon"),
    ("צִיּוֹן", "110_sbl_academic", "ṣiy-yōn", "ṣiy-yōn"),
    ("קֹדֶשׁ", "000_simple_sefardi", "ko-desh", "<strong>ko</strong>-desh"),
    ("קֹדֶשׁ", "010_simple_ashkenazi", "ko-desh", "<strong>ko</strong>-desh"),
    ("קֹדֶשׁ", "110_sbl_academic", "qō-d̲eš", "<strong>qō</strong>-d̲eš"),
    ("כׇּל־הָעָם", "000_simple_sefardi", "kol-ha-'am", "kol-ha-'am"),
    ("כׇּל־הָעָם", "010_simple_ashkenazi", "kol-ho-'om", "kol-ho-'om"),
    ("כׇּל־הָעָם", "110_sbl_academic", "kol-hā-ʿām", "kol-hā-ʿām"),
    ("סֵ֔פֶר", "000_simple_sefardi", "se-fer", "<strong>se</strong>-fer"),
    ("סֵ֔פֶר", "010_simple_ashkenazi", "se-fer", "<strong>se</strong>-fer"),
    ("סֵ֔פֶר", "110_sbl_academic", "sē-p̲er", "<strong>sē</strong>-p̲er"),
)

# Books (English, Hebrew) and sections (English, Hebrew, book) of the query box fixture.
BOX_BOOKS = (("Bereshit", "בראשית"), ("Shemot", "שמות"))
BOX_SECTIONS = (("Noach", "נח", "Bereshit"), ("Lech-Lecha", "לך־לך", "Bereshit"), ("Shemot", "שמות", "Shemot"), ("Bo", "בא", "Shemot"))
# What the query box makes of a text: (text, book, section, chapter, verse, words).
KNOWN_BOXES = (
    ("לך לך יב ג", "Bereshit", "Lech-Lecha", 12, 3, ""),
    ("lech lecha 12 ברא", "Bereshit", "Lech-Lecha", 12, 0, "ברא"),
    ("פרשת נח", "Bereshit", "Noach", 0, 0, ""),
    ("פרשת לך לך ה", "Bereshit", "Lech-Lecha", 5, 0, ""),
    ("בראשית א", "Bereshit", "", 1, 0, ""),
    ("בראשית א א ויאמר", "Bereshit", "", 1, 1, "ויאמר"),
    ("noach", "Bereshit", "Noach", 0, 0, ""),
    ("bereshut א ב ג", "Bereshit", "", 1, 2, "ג"),
    ("מלך בראשית", "", "", 0, 0, "מלך בראשית"),
    ("נח", "Bereshit", "Noach", 0, 0, ""),
    ("שמות ג", "Shemot", "", 3, 0, ""),
    ("בא ויאמר", "Shemot", "Bo", 0, 0, "ויאמר"),
    ("בא מלך", "Shemot", "Bo", 90, 0, ""),
    ("מלך", "", "", 0, 0, "מלך"),
    ("12", "", "", 0, 0, "12"),
)
# Folio places: (text, book, leaf, side, words).
KNOWN_FOLIOS = (
    ("ברכות ב.", "Berakhot", 2, 1, ""),
    ("ברכות ב:", "Berakhot", 2, 2, ""),
    ("brachos 2a", "Berakhot", 2, 1, ""),
    ("ברכות ב עמוד ב מלך", "Berakhot", 2, 2, "מלך"),
    ("ברכות ויאמר", "Berakhot", 0, 0, "ויאמר"),
    ("ברכות מלך", "Berakhot", 90, 0, ""),
    ("מלך ב.", "", 0, 0, "מלך ב"),
)
# What a numeral token means; null if it is none.
KNOWN_NUMERALS = (("א", 1), ("טו", 15), ("טז", 16), ("קכג", 123), ("תתק", 900), ("ך", 20), ("י\"ב", 12), ("ג'", 3), ("77", 77), ("אב", None), ("אי", None), ("תתקא", None), ("x", None), ("", None))
# HTML, its text, and its text without footnotes; only the named entities of XML, nbsp, middot and copy are resolved.
KNOWN_HTML = (
    ("<b>אב</b> גד", "אב גד", "אב גד"),
    ('a<sup class="footnote-marker">1</sup><i class="footnote">see <b>b</b></i> c', "a1see b c", "a c"),
    ("&lt;x&gt; &amp;amp; &quot;q&quot;", '<x> &amp; "q"', '<x> &amp; "q"'),
    (" a&nbsp;b\u2009c\u200b ", "a b c", "a b c"),
    ("a\u00a0&middot;\u00a0&copy;", "a · ©", "a · ©"),
    ("<i>x</i> < y", "x < y", "x < y"),
    ("", "", ""),
)
# Seeds, and what the generator draws first: (seed, (seed * 1103515245 + 12345) mod 2^31 of 2^31 - 1).
KNOWN_DRAWS = ((1, 0.513870078), (0, 0.000005749), (2, 0.027734408))
