"""Regular expressions for court texts, as Java's engine takes them."""

from __future__ import annotations

# The supplier's marks, alphabets and patterns, as the texts and their readers have them.
# (?d) lets only \n end a line, so `.` takes U+2028 and the like; (?s) lets `.` take \n too.
PROVIDED = "Документ предоставлен КонсультантПлюс"
NOTE = r"(?s)-{66}\nКонсультантПлюс.+?-{66}\n"
NOTE_LOOSE = r"(?s)-{66}\nКонсультантПлюс.*?-{66}\n"
HEADER = r"(?d)\AКонсультантПлюс.+?\n.+?\n"
BETWEEN_ACTS = r"\n\n\n-{66}\n\n\n"
CLAIM = r"(?d)(?<=Установил:\n\n|УСТАНОВИЛ:\n\n|установил:\n\n).*(?=\n)"
RESULT_MARK = r"(?d)[Рр]уководствуясь ст.*?(?:Арбитражного процессуального кодекса|АПК)"  # also for "статьями"
ACT = r"(?s)АРБИТРАЖНЫЙ СУД.*?(?=-{66})"
RU_WORD = r"[А-Яа-яЁё]+-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*"
RU_WORD_MARKED = r"[А-Яа-яЁё]+-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*|<S>|</S>"
RU_WORD_MARKED_NUMBERED = r"[А-Яа-яЁё]+-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*|<S>|</S>|[0-9]+[.]*[0-9]*"
ANY_WORD = r"[А-Яа-яЁё]+-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*-?[А-Яа-яЁё]*|[A-Za-z]+-?[A-Za-z]*-?[A-Za-z]*-?[A-Za-z]*|[0-9]+[-.,]*[0-9]*[-.,]*[0-9]*[-.,]*[0-9]*[-.,]*[А-Яа-яЁё]*"
SENTENCE_END = r"(?U)(?<=[\w][\w\)])\.\s+(?=[А-ЯЁ]\s|[А-ЯЁ][А-Яа-яЁё])"
PUNCTUATION = r"\p{Punct}"

#: All but what a Unicode-aware engine calls a word character; Java's own \W is ASCII.
NOT_WORD = r"[^\p{L}\p{N}_]"
