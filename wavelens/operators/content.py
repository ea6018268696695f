"""Rule-based content type of signals, from their descriptors or from what a stream says about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (type, descriptor, above, below, points); all bounds are strict.
RULES = (
    ("music", "zcr", None, 0.1, 2.0), ("music", "harmonic", 0.3, None, 2.0), ("music", "stability", 0.5, None, 1.0), ("music", "range_db", 20.0, None, 1.0),
    ("speech", "zcr", 0.05, 0.3, 2.0), ("speech", "centroid", 800.0, 3000.0, 2.0), ("speech", "harmonic", None, 0.2, 1.0), ("speech", "silence", 0.1, 0.4, 1.0),
    ("sports", "energy_variance", 0.3, None, 2.0), ("sports", "range_db", 30.0, None, 1.5), ("sports", "stability", None, 0.4, 1.0),
)
#: Parts of genre names, and of station names with their addresses, in the order in which the types are tried.
GENRES = (
    ("music", ("rock", "pop", "jazz", "classical", "hip-hop", "hip hop", "country", "electronic", "blues", "reggae", "folk", "metal", "punk", "r&b", "soul", "funk", "dance", "techno", "house", "ambient", "indie", "alternative", "grunge", "ska", "latin", "world", "gospel")),
    ("news", ("news", "talk", "politics", "current affairs", "public radio", "discussion", "interview", "call-in", "spoken word", "commentary", "analysis", "reporting", "journalism", "public affairs")),
    ("sports", ("sports", "football", "basketball", "baseball", "soccer", "hockey", "tennis", "golf", "racing", "motorsports", "athletics", "cricket", "rugby", "boxing", "mma", "sports talk", "sports news")),
)
STATIONS = (
    ("news", ("news", "npr", "bbc", "cnn", "cbc", "abc news", "nbc news", "fox news", "public radio", "current affairs", "talk radio")),
    ("sports", ("sports", "espn", "fox sports", "sports radio", "the fan", "sport", "athletic", "game", "stadium")),
    ("music", ("fm", "music", "hits", "rock", "pop", "jazz", "country", "classic", "radio", "mix", "beat", "sound", "groove")),
)
#: Explicit names of types.
NAMED = {"music": "music", "audio/music": "music", "news": "news", "talk": "news", "spoken": "news", "sports": "sports"}


def content_types(descriptors: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(signal_id, music, speech, sports, talk, content_type): points of each type and the one with the most, above the
    threshold (else unknown). Absent or null descriptors score nothing; ties go to the first of music, news, sports, talk."""
    points = {}
    for kind in ("music", "speech", "sports"):
        points[kind] = F.lit(0.0)
        for k, name, above, below, p in RULES:
            if k == kind and name in descriptors.columns:
                ok = F.col(name).isNotNull()
                ok = ok if above is None else ok & (F.col(name) > above)
                points[kind] = points[kind] + F.when(ok if below is None else ok & (F.col(name) < below), p).otherwise(0.0)
    s = descriptors.select("signal_id", *(c.alias(k) for k, c in points.items())).withColumn("talk", 0.9 * F.col("speech"))
    best = F.greatest("music", "speech", "sports", "talk")
    kind = F.when(best <= threshold, "unknown").when(F.col("music") == best, "music").when(F.col("speech") == best, "news").when(F.col("sports") == best, "sports").otherwise("talk")
    return s.withColumn("content_type", kind)


def _by_parts(text: Column, lists: tuple) -> Column:
    out = F.when(F.lit(False), "")
    for kind, parts in lists:
        out = out.when(text.rlike("|".join(p.replace("&", "[&]") for p in parts)), kind)
    return out.when(text.contains("talk") & ~text.contains("sports"), "talk").otherwise("unknown")


def genre_type(genre: Column) -> Column:
    return _by_parts(F.lower(F.trim(F.coalesce(genre, F.lit("")))), GENRES)


def station_type(station: Column, url: Column) -> Column:
    return _by_parts(F.concat(F.lower(F.trim(F.coalesce(station, F.lit("")))), F.lit(" "), F.lower(F.coalesce(url, F.lit("")))), STATIONS)


def named_type(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for key, kind in NAMED.items():
        out = out.when(F.lower(name) == key, kind)
    return out.otherwise("unknown")


def metadata_types(streams: DataFrame) -> DataFrame:
    """Adds content_type and source to rows with content_type_name, genre, station and url (nulls and empty texts are absent).

    A type that is named wins even if it is unknown, then the genre's, then that of station and address; ``source`` says which decided.
    """
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    genre = genre_type(F.col("genre"))
    by_genre = has("genre") & (genre != "unknown")
    kind = F.when(has("content_type_name"), named_type(F.col("content_type_name"))).when(by_genre, genre).otherwise(station_type(F.col("station"), F.col("url")))
    source = F.when(has("content_type_name"), "content_type").when(by_genre, "genre").when(has("station"), "station").otherwise("url_pattern")
    return streams.withColumns({"content_type": kind, "source": source})


def decided_type(metadata: Column, acoustic: Column, default: str = "unknown") -> Column:
    """The metadata's type, else the acoustic one, else the default."""
    known = lambda c: F.when(c != "unknown", c)
    return F.coalesce(known(metadata), known(acoustic), F.lit(default))


def spectrum_shares(spectra: DataFrame) -> DataFrame:
    """(signal_id, frame, low, high, harmonic): energy shares below and from a quarter of the bins on, and the share of the five-point maxima
    after the first that lie within 0.1 of a whole multiple of it (0 with fewer than two)."""
    m = F.col("m")
    n = F.size(m)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    low, high = total(F.slice(m, F.lit(1), F.floor(n / 4).cast("int"))), total(F.slice(m, F.floor(n / 4).cast("int") + 1, n))
    top = F.filter(F.sequence(F.lit(2), F.greatest(n - 3, F.lit(2))), lambda i: (i < n - 2) & (m[i] > m[i - 1]) & (m[i] > m[i + 1]) & (m[i] > m[i - 2]) & (m[i] > m[i + 2]))
    s = spectra.select("signal_id", "frame", low.alias("a"), high.alias("b"), top.alias("top"))
    first, rest = F.get("top", F.lit(0)), F.expr("slice(top, 2, size(top))")
    whole = F.filter(rest, lambda i: F.abs(i / first - F.round(i / first)) < 0.1)
    both = F.nullif(F.col("a") + F.col("b"), F.lit(0.0))
    return s.select("signal_id", "frame", F.coalesce(F.col("a") / both, F.lit(0.0)).alias("low"), F.coalesce(F.col("b") / both, F.lit(0.0)).alias("high"), F.when(F.size("top") > 1, F.size(whole) / (F.size("top") - 1)).otherwise(0.0).alias("harmonic"))
