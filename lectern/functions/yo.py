"""Words that are always spelled with the letter yo. The rule that restores it is off; its lookup is not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words.
WORDS = """
ещё её неё моё твоё своё чьё чём причём нём
объём приём подъём съём приёмник остриё жильё бельё ружьё копьё питьё шитьё враньё бытиё забытьё
полёт налёт перелёт самолёт вертолёт взлёт счёт расчёт учёт отчёт зачёт почёт счёты
чёрный чёрная чёрное чёрные чёрного чёрной чёрным жёлтый жёлтая жёлтое жёлтые зелёный зелёная зелёное зелёные
тёмный тёмная тёмное тёмные тёплый тёплая тёплое лёгкий лёгкая лёгкое надёжный далёкий весёлый серьёзный тяжёлый чёткий
слёзы слёз звёзды звёзд звёздный сёстры сестёр вёдра гнёзда сёла рёбра бёдра вёсла
козёл орёл ковёр костёр шофёр актёр боксёр чёлка пчёлы щётка тётя тётка мёд лёд ёлка ёж ёжик посёлок новосёл утёс берёза берёзы
нёс вёл шёл пришёл ушёл нашёл пошёл прошёл вошёл произошёл подошёл перешёл обошёл
найдём придём пойдём войдём идём ведём несём берём
""".split()


def restored(word: Column) -> Column:
    """The word with yo, its capitals where they were; null if it isn't listed."""
    known = F.create_map(*[F.lit(x) for w in WORDS for x in (w.replace("ё", "е"), w)])
    found = F.try_element_at(known, F.lower(word))
    letters = F.zip_with(F.split(word, ""), F.split(found, ""), lambda own, new: F.when(own.rlike(r"\A\p{Lu}\z"), F.upper(new)).otherwise(new))
    return F.when(found.isNotNull(), F.array_join(letters, ""))
