"""URL pieces and the key under which hits of one page meet, as Column expressions.

Query values are taken as they stand: percent signs are not decoded and encoded again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters, files and first path segments that do not tell pages apart.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid msclkid yclid ref source".split()
INDEX_FILES = ["index.html", "index.htm", "index.php"]
LOCALES = (
    "ar bg ca cs da de el en es et eu fa fi fr he hr hu is ja ko lt lv nb nl pl pt ro ru sk sl sr sv th tr uk vi zh"
    " ar-sa bg-bg ca-es cs-cz da-dk de-at de-ch de-de el-gr en-au en-ca en-gb en-ie en-in en-nz en-us es-es es-mx fa-ir"
    " fi-fi fr-ca fr-fr he-il hu-hu it-it ja-jp ko-kr nb-no nl-be nl-nl pl-pl pt-br pt-pt ro-ro ru-ru sk-sk sv-se th-th"
    " tr-tr uk-ua vi-vn zh-cn zh-hk zh-tw"
).split()
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    """Lower-cased host without user name and port; null for what is no URL."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, URL, 2), "^.*@", ""), ":[0-9]*$", "")), F.lit(""))


def dedup_key(url: Column) -> Column:
    """scheme://host[:port]path[?query] without fragment, tracking parameters, locale segment,
    index file and trailing slashes, parameters in the order of their names; null for what is no URL."""
    scheme, port = F.lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(F.regexp_extract(url, URL, 2), r":([0-9]+)$", 1)
    standard = F.when(scheme == "http", "80").when(scheme == "https", "443").otherwise("")
    path = F.regexp_replace(F.regexp_extract(url, URL, 3), f"^/(?i:{'|'.join(x.replace('-', '[-_]') for x in LOCALES)})/", "/")
    path = F.regexp_replace(path, rf"(?:{'|'.join(x.replace('.', '[.]') for x in INDEX_FILES)})$", "")
    path = F.regexp_replace(path, "/+$", "")
    pairs = F.transform(
        F.filter(F.split(F.regexp_extract(url, URL, 4), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING)),
        lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")),
    )
    query = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["p"]), "&")
    full = F.concat(
        scheme,
        F.lit("://"),
        host(url),
        F.when((port == "") | (port == standard), "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(url.rlike(URL), full)


def under(name: Column, domain: Column) -> Column:
    """A host is a domain or below it, on a label boundary."""
    return (name == domain) | F.endswith(name, F.concat(F.lit("."), domain))
