"""The word lists, patterns and thresholds of the cleaning rules.

Patterns are Java regular expressions that are matched against one line at a time.
"""

# Lines that are page numbers or broken dividers, ignoring case.
PAGE_NUMBERS = (
    r"^\d+$",
    r"^[ivxlcdm]+$",
    r"^[IVXLCDM]+$",
    r"^Page\s+\d+$",
    r"^p\.?\s*\d+$",
    r"^\d+\s+of\s+\d+$",
    r"^-\s*\d+\s*-$",
    r"^-\s*[ivxlcdm]+\s*-$",
    r"^-\s*[IVXLCDM]+\s*-$",
    r"^—\s*\d+\s*—$",
    r"^—\s*[ivxlcdm]+\s*—$",
    r"^—\s*[IVXLCDM]+\s*—$",
    r"^\[\d+\]$",
    r"^--\s*-$",
    r"^-\s*--$",
    r"^---$",
    r"^--$",
    r"^—\s*-$",
    r"^-\s*—$",
    r"^\s*—\s*$",
)

# Broken encodings and what they stand for, and ligatures.
MOJIBAKE = {
    "â\u0080\u0094": "—", "â\u0080\u0093": "–", "Ã¢â‚¬â€œ": "—", "â€”": "—", "â€“": "–",
    "â\u0080\u009c": "“", "â\u0080\u009d": "”", "â\u0080\u0098": "‘", "â\u0080\u0099": "’",
    "â€œ": "“", "â€": "”", "â€˜": "‘", "â€™": "’",
    "Ïƒ": "σ", "Îµ": "ε", "Î±": "α", "Î²": "β", "Î³": "γ", "Î´": "δ", "Î¼": "μ", "Ï€": "π", "Î£": "Σ", "Î”": "Δ", "Î©": "Ω",
    "Ã©": "é", "Ã¨": "è", "Ã\u00a0": "à", "Ã¡": "á", "Ã\u00ad": "í", "Ã³": "ó", "Ãº": "ú", "Ã±": "ñ", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "Ã§": "ç",
    "âˆš": "√", "âˆž": "∞", "Â½": "½", "Â¼": "¼", "Â¾": "¾", "Â°": "°", "Â±": "±", "Ã—": "×", "Ã·": "÷",
    "â‰¤": "≤", "â‰¥": "≥", "â‰ˆ": "≈", "â‚\u0081": "₁", "â‚‚": "₂", "â‚ƒ": "₃", "â±": "ⁱ", "â¿": "ⁿ",
    "â€¢": "•", "â€¦": "…", "Â©": "©", "Â®": "®", "â„¢": "™",
}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae"}
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad\u2060\u180e\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
QUOTES = {"“”„‟«»″": '"', "‘’‚‛‹›`´′": "'"}
REMOVED_CHARACTERS = ("[", "]", "\\*", "_")

# A surname in a citation; citations; what citations leave behind; footnote markers.
NAME = r"[A-Z][A-Za-zÀ-ÖØ-öø-ÿĀ-žḀ-ỿ\-']+"
PAGES = r"pp?\.?\s*\d+(?:[–\-]\d+)?"
CUE = r"(?:see|cf\.?|e\.?g\.?|i\.?e\.?)"
OP_CIT = r"(?:ibid\.?|op\.?\s*cit\.?|loc\.?\s*cit\.?)"
CITATIONS = (
    rf"\({NAME}(?:\s+(?:&|and)\s+{NAME})*,\s*\d{{4}}(?:[a-z])?(?:,\s*{PAGES})?\)",
    rf"\({NAME}\s+et\s+al\.?,\s*\d{{4}}(?:,\s*{PAGES})?\)",
    rf"\({NAME}(?:\s+(?:&|and)\s+{NAME})*\s+\d{{4}}(?:,\s*{PAGES})?\)",
    rf"\({CUE}\s+{NAME}(?:,\s*|\s+)\d{{4}}(?:[a-z])?(?:,\s*{PAGES})?\)",
    rf"\({CUE}\s+{NAME}(?:,\s*|\s+)\d{{4}}(?:[a-z])?(?:;\s*(?:{CUE}\s+)?{NAME}(?:,\s*|\s+)\d{{4}}(?:[a-z])?)+\)",
    rf"\({NAME}(?:,\s*|\s+)\d{{4}}(?:[a-z])?(?:;\s*{NAME}(?:,\s*|\s+)\d{{4}}(?:[a-z])?)+\)",
    rf"\({NAME}\s+\d{{4}},?\s+as\s+cited\s+in\s+{NAME},?\s*\d{{4}}(?:,\s*{PAGES})?\)",
    rf"\({NAME}\s+\d{{4}},\s*\d{{1,4}}(?:[–\-]\d{{1,4}})?\)",
    rf"\({NAME}(?:\s+(?:&|and)\s+{NAME})?\s+\d+(?:[–\-]\d+)?\)",
    r"(?<=[\s(,;])\[\d+(?:[–\-,]\s*\d+)*\](?=[\s.,;:)\]]|$)",
    r"(?<=\p{L}\p{L})[¹²³⁰-⁹]+(?=[\s\.,;:\)\]”]|$)",
    rf"\({OP_CIT}(?:,?\s*{PAGES})?\)",
    rf"\b{OP_CIT}\b",
    rf"\({NAME},\s*(?:ibid|op\.?\s*cit|loc\.?\s*cit)\.?(?:,?\s*{PAGES})?\)",
    rf"\({NAME}\s+\d{{4}}:\s*\d+(?:[–\-]\d+)?\)",
    rf"\((?:Ch(?:apter)?\.?\s*\d+,\s*)?{PAGES}\)",
    rf"{NAME}\s+\(\d{{4}}[a-z]?\)",
)
ORPHANS = (
    (r"\(\s*,?\s*pp?\.\s*\d+(?:[–\-]\d+)?\s*\)", ""),
    (rf"\(\s*{CUE}\s*\)", ""),
    (r"\(\s*[,;\s]+\s*\)", ""),
    (r"\(\s*et\s+al\.?\s*,?\s*\)", ""),
    (r",\s*,", ","),
    (r"\s+,", ","),
    (rf"\(\s*{NAME},\s*\.+,?\s*{PAGES}\s*\)", ""),
    (rf"\(\s*{NAME},\s*{PAGES}\s*\)", ""),
    (r"\(\s*as\s+cited\s+in\s*[A-Za-zÀ-ÖØ-öø-ÿĀ-žḀ-ỿ\-']*,?\s*\)", ""),
    (rf"\(\s*{NAME},?\s*\)", ""),
    (r";\s*\)", ")"),
    (r"\(\s+\)", ""),
)
FOOTNOTE_MARKERS = (
    r"(?<=[a-zà-öø-ÿā-žḁ-ỿ]{3})[¹²³⁰-⁹]+(?=[\s\.,;:\)\]”]|$)",
    r"\[\d+\]",
    r"\^\(\d+\)",
    r"[\*†‡§¶‖]+(?=\s|$|[.,;:])",
    r"\^[a-z](?=\s|$|[.,;:])",
)
BIBLIOGRAPHY_WORDS = ("Publisher", "Press", "Journal", "University", "Vol.", "pp.", "doi:", "Retrieved from", "https://", "http://", "ISBN")

# Named patterns that a document's own style is voted from.
VOTES = {
    "page_number": (
        ("plain", r"^\s*(\d{1,4})\s*$"), ("decoratedDash", r"^\s*[-–—]\s*(\d{1,4})\s*[-–—]\s*$"), ("bracketed", r"^\s*\[(\d{1,4})\]\s*$"),
        ("prefixedPage", r"^\s*[Pp]age\s+(\d{1,4})\s*$"), ("prefixedP", r"^\s*[Pp]\.\s*(\d{1,4})\s*$"), ("roman", r"^\s*([ivxlcdm]+|[IVXLCDM]+)\s*$"),
    ),
    "citation": (
        ("authorYear", r"\([A-Z][a-z]+(?:\s+(?:&|and)\s+[A-Z][a-z]+)?,\s*\d{4}[a-z]?\)"), ("numberedBracket", r"\[\d+(?:[-,]\s*\d+)*\]"),
        ("numberedParen", r"\(\d+(?:[-,]\s*\d+)*\)"), ("superscript", r"[²³¹⁰-⁹]+"), ("ibid", r"(?i)\b(?:ibid|op\.\s*cit\.|loc\.\s*cit\.)\b"),
    ),
    "footnote": (
        ("superscriptNumber", r"[¹²³⁰-⁹]+"), ("asterisk", r"\*+"), ("dagger", r"[†‡]+"), ("bracketedNumber", r"\[(\d+)\]"), ("parenNumber", r"\((\d+)\)"),
    ),
}

# Headings after one to three # (any) and headings on a plain line, with their weights.
BACK_HEADINGS = {
    1.0: ("NOTES", "Notes", "ENDNOTES", "Endnotes"),
    0.95: ("GLOSSARY", "Glossary", "BIBLIOGRAPHY", "Bibliography", "WORKS CITED", "Works Cited"),
    0.9: ("APPENDIX", "Appendix", r"APPENDIX\s+[A-Z]", r"Appendix\s+[A-Z]", "REFERENCES", "References", "COLOPHON", "Colophon", "NOTAS", "BIBLIOGRAFÍA", "GLOSARIO", "ANNEXE", "GLOSSAIRE", "ANHANG", "GLOSSAR"),
    0.85: ("ABOUT THE AUTHOR", "About the Author", "ABOUT THE AUTHORS", "About the Authors"),
    0.8: ("ACKNOWLEDGMENTS", "Acknowledgments", "ACKNOWLEDGEMENTS", "Acknowledgements"),
    0.7: ("AFTERWORD", "Afterword"),
}
BACK_PLAIN = {
    0.9: ("NOTES", "ENDNOTES", "GLOSSARY", "BIBLIOGRAPHY", "WORKS CITED"),
    0.85: ("APPENDIX", "APPENDIX [A-Z]", "REFERENCES"),
    0.8: ("ABOUT THE AUTHOR",),
    0.75: ("ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS"),
}
INDEX_HEADINGS = {1.0: ("INDEX", "Index", "SUBJECT INDEX", "Subject Index", "NAME INDEX", "Name Index", "GENERAL INDEX", "General Index"), 0.9: ("ÍNDICE", "REGISTER")}
INDEX_PLAIN = {0.9: ("INDEX", "SUBJECT INDEX")}
INDEX_ENTRY = r"^\s*[A-Za-z][A-Za-z\s,'-]*,\s*\d+(-\d+)?(,\s*\d+(-\d+)?)*\s*$"
LETTER_DIVIDER = r"^\s*[A-Z]\s*$"
FRONT_INDICATORS = (
    (r"©\s*\d{4}", 1.0), (r"Copyright\s*©?\s*\d{4}", 1.0), (r"All rights reserved", 0.9), (r"ISBN\s*[-:\s]?\s*\d", 1.0), (r"Library of Congress", 0.95),
    (r"First published", 0.85), (r"First edition", 0.85), (r"Published by", 0.8), (r"Printed in", 0.75),
)
MAIN_STARTS = (
    (r"^#{1,2}\s*Chapter\s+\d", 1.0), (r"^#{1,2}\s*CHAPTER\s+\d", 1.0), (r"^#{1,2}\s*Chapter\s+One", 1.0), (r"^#{1,2}\s*CHAPTER\s+ONE", 1.0),
    (r"^#{1,2}\s*Part\s+[IVXLC]+", 0.9), (r"^#{1,2}\s*PART\s+[IVXLC]+", 0.9), (r"^#{1,2}\s*1\.\s+[A-Z]", 0.8),
    (r"^#{1,2}\s*Prologue\s*$", 0.9), (r"^#{1,2}\s*PROLOGUE\s*$", 0.9),
)
TOC_HEADERS = (
    (r"^#{1,3}\s*TABLE OF CONTENTS\s*$", 1.0), (r"^#{1,3}\s*Table of Contents\s*$", 1.0), (r"^#{1,3}\s*CONTENTS\s*$", 1.0), (r"^#{1,3}\s*Contents\s*$", 1.0),
    (r"^TABLE OF CONTENTS$", 0.9), (r"^CONTENTS$", 0.9), (r"^#{1,3}\s*TABLA DE CONTENIDOS\s*$", 0.9), (r"^#{1,3}\s*TABLE DES MATIÈRES\s*$", 0.9), (r"^#{1,3}\s*INHALTSVERZEICHNIS\s*$", 0.9),
)
TOC_ENTRY = r"^.+\s{2,}\.{2,}\s*\d+\s*$|^.+\s{4,}\d+\s*$"
PAGED_LINE = r"^.{5,}\s+\d{1,4}\s*$"
LIST_HEADINGS = {
    1.0: ("LIST OF FIGURES", "List of Figures", "LIST OF TABLES", "List of Tables", "LIST OF ILLUSTRATIONS", "List of Illustrations", "LIST OF PLATES", "LIST OF MAPS", "LIST OF CHARTS", "LIST OF GRAPHS", "LIST OF ABBREVIATIONS", "List of Abbreviations", "LIST OF SYMBOLS", "LIST OF ACRONYMS"),
    0.9: ("ABBREVIATIONS", "Abbreviations", "LISTA DE FIGURAS", "LISTA DE TABLAS", "LISTE DES FIGURES", "LISTE DES TABLEAUX", "ABBILDUNGSVERZEICHNIS", "TABELLENVERZEICHNIS"),
    0.85: ("FIGURES", "Figures", "TABLES", "Tables"),
}
LIST_PLAIN = {
    0.9: ("LIST OF FIGURES", "LIST OF TABLES", "LIST OF ILLUSTRATIONS", "LIST OF PLATES", "LIST OF MAPS", "LIST OF ABBREVIATIONS", "LIST OF SYMBOLS"),
    0.85: ("ABBREVIATIONS",),
    0.8: ("FIGURES", "TABLES", "SYMBOLS"),
}
LIST_TYPES = (
    ("FIGURE|ABBILDUNG", "List of Figures"), ("TABLE|TABELLE", "List of Tables"), ("ILLUSTRATION", "List of Illustrations"), ("PLATE", "List of Plates"), ("MAP", "List of Maps"),
    ("CHART", "List of Charts"), ("GRAPH", "List of Graphs"), ("ABBREVIATION|ABK", "List of Abbreviations"), ("SYMBOL", "List of Symbols"), ("ACRONYM", "List of Acronyms"),
)
LIST_ENTRIES = (
    r"^\s*(Figure|Fig\.|FIGURE|FIG\.)\s*\d+", r"^\s*(Table|Tab\.|TABLE|TAB\.)\s*\d+", r"^\s*(Illustration|Plate|Map|Chart|Graph)\s*\d+",
    r"^\s*[A-Z]{2,}\s*[-–:]\s*[A-Z]", r"^.+\.{3,}\s*\d+\s*$",
)
ABBREVIATION = r"^[A-Z]{2,10}\s*[—–\-=:]\s*.{5,}"
CONTRIBUTOR = r"^Chapter\s+\d+\s*:\s*[A-Z][a-z]+"
NOTES_START = r"^#{1,2}\s*(NOTES|Notes|ENDNOTES|Endnotes|END NOTES|End Notes)\s*$|^(NOTES|ENDNOTES)\s*$"
NOTES_END = r"^#{1,2}\s*(INDEX|Index|APPENDIX|Appendix|GLOSSARY|Glossary|BIBLIOGRAPHY|Bibliography|REFERENCES|References|ACKNOWLEDGMENTS|Acknowledgments|ABOUT THE AUTHOR|About the Author)"
FRONT_WORDS = ("table of contents", "contents", "foreword", "preface", "acknowledgments", "dedication", "copyright")
CORE_WORDS = ("chapter 1", "chapter one", "part one", "introduction", "prologue")
BACK_WORDS = ("bibliography", "references", "works cited", "index", "glossary", "appendix", "endnotes", "notes", "about the author")

# Headings and lines that confirm a section.
CONFIRM_BACK = ("NOTES", "ENDNOTES", "FOOTNOTES", "APPENDIX", "APPENDICES", "GLOSSARY", "BIBLIOGRAPHY", "REFERENCES", "WORKS CITED", "SOURCES", "ABOUT THE AUTHOR", "ABOUT THE AUTHORS", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS", "COLOPHON", "AFTERWORD", "NOTAS", "APÉNDICE", "GLOSARIO", "BIBLIOGRAFÍA", "SOBRE EL AUTOR", "AGRADECIMIENTOS", "ANNEXE", "ANNEXES", "GLOSSAIRE", "BIBLIOGRAPHIE", "À PROPOS DE L'AUTEUR", "REMERCIEMENTS", "ANHANG", "GLOSSAR", "LITERATURVERZEICHNIS", "ÜBER DEN AUTOR", "DANKSAGUNG", "NOTAS", "APÊNDICE", "GLOSSÁRIO", "BIBLIOGRAFIA", "SOBRE O AUTOR", "AGRADECIMENTOS")
CONFIRM_BACK_PATTERNS = (
    r"^#{1,3}\s*(NOTES|Notes|Endnotes|ENDNOTES)", r"^#{1,3}\s*(APPENDIX|Appendix|APPENDICES|Appendices)", r"^#{1,3}\s*(GLOSSARY|Glossary)", r"^#{1,3}\s*(BIBLIOGRAPHY|Bibliography|REFERENCES|References)",
    r"^#{1,3}\s*(ABOUT THE AUTHOR|About the Author)", r"^#{1,3}\s*(ACKNOWLEDGMENTS|Acknowledgments|ACKNOWLEDGEMENTS|Acknowledgements)", r"^#{1,3}\s*(COLOPHON|Colophon)", r"^#{1,3}\s*(AFTERWORD|Afterword)",
)
CHAPTERS = (
    r"^#{1,2}\s*Chapter\s+\d", r"^#{1,2}\s*CHAPTER\s+\d", r"^#{1,2}\s*Chapter\s+[IVXLC]+", r"^#{1,2}\s*\d+\.\s+[A-Z]",
    r"^CHAPTER\s+(ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", r"^Part\s+[IVXLC]+", r"^PART\s+[IVXLC]+",
)
CONFIRM_INDEX = ("INDEX", "SUBJECT INDEX", "NAME INDEX", "AUTHOR INDEX", "GENERAL INDEX", "COMBINED INDEX", "ÍNDICE", "ÍNDICE ALFABÉTICO", "ÍNDICE ONOMÁSTICO", "INDEX ALPHABÉTIQUE", "REGISTER", "SACHREGISTER", "NAMENSREGISTER")
CONFIRM_INDEX_ENTRY = r"^\s*[A-Za-z].+,\s*\d+(-\d+)?(,\s*\d+(-\d+)?)*\s*$"
CONFIRM_FRONT = ("©", "Copyright", "All rights reserved", "ISBN", "Library of Congress", "First published", "First edition", "Published by", "Printed in", "Dedication", "For ", "To my ", "PREFACE", "Preface", "FOREWORD", "Foreword", "INTRODUCTION", "Introduction", "TABLE OF CONTENTS", "CONTENTS")
CONFIRM_TOC = ("TABLE OF CONTENTS", "CONTENTS", "TABLA DE CONTENIDOS", "CONTENIDO", "TABLE DES MATIÈRES", "SOMMAIRE", "INHALTSVERZEICHNIS")
CONFIRM_TOC_ENTRY = r"^.+\s{2,}\.{2,}\s*\d+$|^.+\s{3,}\d+$"
CONFIRM_TOC_LISTING = r"^.*(Chapter|CHAPTER|Part|PART|\d+\.).*\d+\s*$"
CONFIRM_LIST = ("LIST OF FIGURES", "FIGURES", "ILLUSTRATIONS", "LIST OF ILLUSTRATIONS", "LIST OF PLATES", "LISTA DE FIGURAS", "LISTE DES FIGURES", "ABBILDUNGSVERZEICHNIS", "LIST OF TABLES", "TABLES", "LISTA DE TABLAS", "LISTE DES TABLEAUX", "TABELLENVERZEICHNIS", "LIST OF MAPS", "MAPS", "LIST OF CHARTS", "CHARTS", "LIST OF GRAPHS", "GRAPHS", "LIST OF ABBREVIATIONS", "ABBREVIATIONS", "LIST OF SYMBOLS", "SYMBOLS", "LIST OF ACRONYMS", "ACRONYMS", "GLOSSARY OF TERMS", "LISTA DE ABREVIATURAS", "ABRÉVIATIONS", "ABKÜRZUNGSVERZEICHNIS", "LIST OF APPENDICES", "LIST OF CONTRIBUTORS")
CONFIRM_LIST_PATTERNS = (
    r"^#{1,3}\s*(LIST OF FIGURES|List of Figures|Figures|FIGURES)", r"^#{1,3}\s*(LIST OF TABLES|List of Tables|Tables|TABLES)", r"^#{1,3}\s*(LIST OF ILLUSTRATIONS|List of Illustrations|Illustrations)",
    r"^#{1,3}\s*(LIST OF MAPS|List of Maps|Maps)", r"^#{1,3}\s*(LIST OF ABBREVIATIONS|List of Abbreviations|Abbreviations)", r"^#{1,3}\s*(LIST OF SYMBOLS|List of Symbols|Symbols)",
)
CONFIRM_NOTES = ("NOTES", "ENDNOTES", "FOOTNOTES", "CHAPTER NOTES", "NOTES TO CHAPTER", "NOTES AND REFERENCES", "NOTES AND SOURCES", "NOTAS", "NOTAS FINALES", "NOTAS AL PIE", "NOTES DE FIN", "NOTES DE BAS DE PAGE", "ANMERKUNGEN", "ENDNOTEN", "FUSSNOTEN", "NOTAS DE RODAPÉ", "NOTAS FINAIS")
CONFIRM_NOTES_PATTERNS = (r"^#{1,3}\s*(NOTES|Notes|Endnotes|ENDNOTES|Footnotes|FOOTNOTES)", r"^#{1,3}\s*(Chapter\s+\d+\s+Notes|Notes\s+to\s+Chapter)", r"^#{1,3}\s*(Notes\s+and\s+References|Notes\s+and\s+Sources)")
CONFIRM_NOTES_ENTRIES = (r"^\s*\d{1,3}[.:]\s+[A-Z]", r"^\s*[\[\(]\d{1,3}[\]\)]\s+", r"^\s*(Chapter|Ch\.)\s*\d+.*note\s*\d+", r"\bp{1,2}\.\s*\d+", r"^\s*(See|Cf\.|Compare|Note|Ibid|Op\.\s*cit)")
NARRATIVE = (r'"[A-Z][^"]{20,}"', r"[A-Z][^.!?]{100,}[.!?]")

# Words of the content-type rules.
CODE_WORDS = ("def ", "class ", "import ", "func ", "let ", "var ", "struct ", "function ", "const ", "public ", "private ", "static ")
MATH_SIGNS = ("²", "³", "⁴", "⁵", "σ", "ε", "π", "α", "β", "γ", "δ", "λ", "μ", "θ", "Σ", "Δ", "Π", "Ω", "√", "∑", "∫", "∂", "≈", "≠", "≤", "≥", "±", "equation", "formula", "theorem")
NUMBER_WORDS = "One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve|Thirteen|Fourteen|Fifteen|Sixteen|Seventeen|Eighteen|Nineteen|Twenty"
NOT_CHAPTERS = ("# notes", "# index", "# appendix", "# bibliography", "# glossary", "# references", "# acknowledgment", "# about the author", "# contents", "# table of contents")
