"""Names, labels and addresses that results are shown with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import encode_query, first_words

# Names of the suras in order, Arabic and transliterated.
SURAS = [
    "الفاتحة", "البقرة", "آل عمران", "النساء", "المائدة", "الأنعام", "الأعراف", "الأنفال", "التوبة", "يونس",
    "هود", "يوسف", "الرعد", "إبراهيم", "الحجر", "النحل", "الإسراء", "الكهف", "مريم", "طه",
    "الأنبياء", "الحج", "المؤمنون", "النور", "الفرقان", "الشعراء", "النمل", "القصص", "العنكبوت", "الروم",
    "لقمان", "السجدة", "الأحزاب", "سبأ", "فاطر", "يس", "الصافات", "ص", "الزمر", "غافر",
    "فصلت", "الشورى", "الزخرف", "الدخان", "الجاثية", "الأحقاف", "محمد", "الفتح", "الحجرات", "ق",
    "الذاريات", "الطور", "النجم", "القمر", "الرحمن", "الواقعة", "الحديد", "المجادلة", "الحشر", "الممتحنة",
    "الصف", "الجمعة", "المنافقون", "التغابن", "الطلاق", "التحريم", "الملك", "القلم", "الحاقة", "المعارج",
    "نوح", "الجن", "المزمل", "المدثر", "القيامة", "الإنسان", "المرسلات", "النبأ", "النازعات", "عبس",
    "التكوير", "الانفطار", "المطففين", "الانشقاق", "البروج", "الطارق", "الأعلى", "الغاشية", "الفجر", "البلد",
    "الشمس", "الليل", "الضحى", "الشرح", "التين", "العلق", "القدر", "البينة", "الزلزلة", "العاديات",
    "القارعة", "التكاثر", "العصر", "الهمزة", "الفيل", "قريش", "الماعون", "الكوثر", "الكافرون", "النصر",
    "المسد", "الإخلاص", "الفلق", "الناس",
]
SURAS_EN = [
    "Al-Fatihah", "Al-Baqarah", "Al Imran", "An-Nisa", "Al-Ma'idah", "Al-An'am", "Al-A'raf", "Al-Anfal", "At-Tawbah", "Yunus",
    "Hud", "Yusuf", "Ar-Ra'd", "Ibrahim", "Al-Hijr", "An-Nahl", "Al-Isra", "Al-Kahf", "Maryam", "Ta-Ha",
    "Al-Anbiya", "Al-Hajj", "Al-Mu'minun", "An-Nur", "Al-Furqan", "Ash-Shu'ara", "An-Naml", "Al-Qasas", "Al-'Ankabut", "Ar-Rum",
    "Luqman", "As-Sajdah", "Al-Ahzab", "Saba", "Fatir", "Ya-Sin", "As-Saffat", "Sad", "Az-Zumar", "Ghafir",
    "Fussilat", "Ash-Shura", "Az-Zukhruf", "Ad-Dukhan", "Al-Jathiyah", "Al-Ahqaf", "Muhammad", "Al-Fath", "Al-Hujurat", "Qaf",
    "Adh-Dhariyat", "At-Tur", "An-Najm", "Al-Qamar", "Ar-Rahman", "Al-Waqi'ah", "Al-Hadid", "Al-Mujadilah", "Al-Hashr", "Al-Mumtahanah",
    "As-Saff", "Al-Jumu'ah", "Al-Munafiqun", "At-Taghabun", "At-Talaq", "At-Tahrim", "Al-Mulk", "Al-Qalam", "Al-Haqqah", "Al-Ma'arij",
    "Nuh", "Al-Jinn", "Al-Muzzammil", "Al-Muddaththir", "Al-Qiyamah", "Al-Insan", "Al-Mursalat", "An-Naba", "An-Nazi'at", "'Abasa",
    "At-Takwir", "Al-Infitar", "Al-Mutaffifin", "Al-Inshiqaq", "Al-Buruj", "At-Tariq", "Al-A'la", "Al-Ghashiyah", "Al-Fajr", "Al-Balad",
    "Ash-Shams", "Al-Layl", "Ad-Duha", "Ash-Sharh", "At-Tin", "Al-'Alaq", "Al-Qadr", "Al-Bayyinah", "Az-Zalzalah", "Al-'Adiyat",
    "Al-Qari'ah", "At-Takathur", "Al-'Asr", "Al-Humazah", "Al-Fil", "Quraysh", "Al-Ma'un", "Al-Kawthar", "Al-Kafirun", "An-Nasr",
    "Al-Masad", "Al-Ikhlas", "Al-Falaq", "An-Nas",
]

# Labels of the kinds of result, and of the parts of a card.
KINDS = {
    "quran_exact": ("مطابق لنص المصحف", "Matches the Quran text"),
    "hadith_authentic": ("حديث ثابت", "Authentic hadith"),
    "different_wording": ("ورد بلفظ مختلف", "Reported with different wording"),
    "weak_or_fabricated": ("ضعيف أو موضوع", "Weak or fabricated"),
    "scholars_differed": ("اختلف العلماء في الحكم عليه", "Scholars differed in grading it"),
    "not_found": ("لم نعثر على المصدر", "Source not found"),
    "rulings_verbatim": ("أحكام العلماء كما وردت في المصدر", "Scholars' rulings as stated in the source"),
}
PARTS = {
    "checked": ("النص المفحوص", "Checked text"),
    "correct_wording": ("اللفظ الصحيح من المصدر", "Correct wording from the source"),
    "source_text": ("النص في المصدر", "Text in the source"),
    "rulings": ("حكم العلماء", "Scholars' rulings"),
    "scholar": ("المحدث", "Scholar"),
    "book": ("المصدر", "Book"),
    "number": ("الصفحة أو الرقم", "Page or number"),
    "references": ("المرجع", "Reference"),
    "also_at": ("وردت أيضًا في", "Also in"),
    "wording_note": ("لفظ المنشور يختلف عن لفظ المصدر.", "The post's wording differs from the source."),
    "error": ("تعذر الفحص الآن", "Could not check right now"),
}
REPORTS_NAME = "موسوعة الأحاديث النبوية"
RULINGS_NAME = "الدرر السنية - الموسوعة الحديثية"
NOTES = {"verses": "النص من موسوعة القرآن الكريم (QuranEnc).", "reports": "الحكم والتخريج كما نشرتهما موسوعة الأحاديث النبوية."}
VERSE_PAGE = "https://quranenc.com/ar/browse/english_saheeh/"
REPORT_PAGE = "https://hadeethenc.com/{lang}/browse/hadith/"
RULING_PAGE = "https://dorar.net/hadith/search"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label(key: Column | str, lang: str = "ar", table: dict[str, tuple[str, str]] | None = None) -> Column:
    """The label of a kind, or of a part of a card; null for an unknown one."""
    pairs = [x for k, v in (table or KINDS | PARTS).items() for x in (F.lit(k), F.lit(v[lang == "en"]))]
    return F.create_map(*pairs)[_c(key)]


def sura_name(sura: Column | str, lang: str = "ar") -> Column:
    """A sura's name; its number where it has none."""
    names = F.array(*map(F.lit, SURAS_EN if lang == "en" else SURAS))
    return F.coalesce(F.get(names, _c(sura).cast("int") - 1), _c(sura).cast("string"))


def sura_label(sura: Column | str, lang: str = "ar") -> Column:
    """The name after the word for sura."""
    return F.concat(F.lit("Surah " if lang == "en" else "سورة "), sura_name(sura, lang))


def verse_range(first: Column | str, last: Column | str) -> Column:
    a, b = _c(first), _c(last)
    return F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))


def verse_label(sura: Column | str, first: Column | str, last: Column | str) -> Column:
    """N15, C13, the service profile's reference: the sura's name and the range of verses."""
    return F.concat(sura_label(sura), F.lit(" · الآية "), verse_range(first, last))


def verse_url(sura: Column | str, aya: Column | str) -> Column:
    """The page of a verse."""
    return F.concat(F.lit(VERSE_PAGE), _c(sura).cast("string"), F.lit("#"), _c(aya).cast("string"))


def report_url(report_id: Column | str, lang: str = "ar") -> Column:
    """The page of a report."""
    return F.concat(F.lit(REPORT_PAGE.format(lang=lang)), _c(report_id))


def rulings_url(text: Column | str) -> Column:
    """The search for a text's first twelve words."""
    return F.concat(F.lit(RULING_PAGE + "?q="), encode_query(first_words(text)))
