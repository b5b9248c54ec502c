"""Variant spellings of persons and organisations in names typed by people.

Every distinct value is parsed once into a core token (surname, or the distinctive word of an
organisation) and a partner (the given names it may stand for, or the trades). Cores are compared within
the partner: those of 6 letters and more that share a suffix of half their length, or one of their
reversals, and those of up to 6 letters that are equal but for one letter of each. A suffix that is too
common even with the partner is refined by what is left of the core without some letters, which loses no
pair: two cores with a common suffix and a long enough common subsequence have such a rest in common.
What decides is the longest-common-subsequence ratio (``alike``), the same for every size of a block.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import checkpoint

# Titles, legal forms, office words, given names, their short forms, trades.
TITLES = set("avv avvocato dott dottor dottore dottssa dottoressa dr drssa ing ingegner arch architetto geom geometra rag ragioniere sig sigra signor signora sigg prof profssa professor on notaio cav gent egr spett mr mrs ms herr frau mme m.me".split())
LEGAL = re.compile(r"(?<!\w)(?:s\.?\s?r\.?\s?l\.?\s?s?|s\.?\s?p\.?\s?a|s\.?\s?n\.?\s?c|s\.?\s?a\.?\s?s|s\.?\s?s|soc\.?\s?coop|scarl|gmbh|ltd|inc|onlus)\.?(?!\w)")
OFFICES = ("ufficio", "uff", "settore", "segreteria", "segr", "amministrazione", "amm", "protocollo", "prot", "servizio", "direzione", "area", "sportello", "reparto", "sede", "filiale", "tributi", "gare", "personale")
GIVEN = tuple(
    "adriana adriano agnese alberto alessandra alessandro alessia alessio alfredo alice andrea angela angelo anna antonella antonio arianna aurora barbara bartolomeo beatrice bruno camilla carla carlo carmela caterina "
    "cecilia cesare chiara cinzia claudia claudio concetta corrado cristian cristina daniela daniele dario davide debora diego domenica domenico edoardo elena eleonora elisa elisabetta emanuela emanuele emilio enrica enrico "
    "ernesto ettore eugenio fabio fabrizio federica federico filippo filomena francesca francesco franco gabriele gaetano gennaro giacomo gianluca ginevra giorgia giorgio giovanna giovanni giulia giulio giuseppe giuseppina "
    "grazia guglielmo guido ilaria irene ivan laura leonardo letizia lorenzo loredana luca lucia luciano ludovica ludovico luigi luisa maddalena manuela marcello marco margherita maria mario marta martina massimo matteo "
    "maurizio mauro michela michelangelo michele milena mirko monica nadia nicola nicoletta ornella osvaldo paola paolo patrizia piero pietro raffaela raffaele raffaella renata renato riccardo rita roberta roberto rocco "
    "rosa rosalia rosanna ruggero sabrina salvatore sandra sara sergio silvia silvio simona simone sofia stefania stefano susanna teresa tiziana tommaso ugo umberto valentina valerio vincenza vincenzo vittoria vittorio viviana".split()
)
SHORT = {
    "ale": "alessandra alessandro alessia alessio", "sandra": "alessandra", "sandro": "alessandro", "alex": "alessandro alessandra", "lella": "antonella raffaella", "anto": "antonella antonio", "toni": "antonio", "tony": "antonio", "tonino": "antonio",
    "nino": "antonio", "meo": "bartolomeo", "bortolo": "bartolomeo", "bea": "beatrice", "bice": "beatrice", "rina": "caterina", "cate": "caterina", "katia": "caterina", "tina": "concetta cristina", "titti": "concetta",
    "cri": "cristina", "dani": "daniela daniele", "dany": "daniela daniele", "mimma": "domenica", "mimmo": "domenico", "menico": "domenico", "nora": "eleonora", "ele": "eleonora elena", "betta": "elisabetta", "betti": "elisabetta", "lisa": "elisabetta elisa",
    "lele": "emanuele raffaele", "manu": "emanuele emanuela manuela", "fede": "federica federico", "chicco": "federico francesco enrico", "rico": "federico enrico", "mena": "filomena", "cesca": "francesca", "franci": "francesca", "checca": "francesca",
    "checco": "francesco", "franz": "francesco", "cecco": "francesco", "ciccio": "francesco", "vanna": "giovanna", "gianna": "giovanna", "gianni": "giovanni", "vanni": "giovanni", "giò": "giovanni giovanna", "nanni": "giovanni", "peppe": "giuseppe",
    "beppe": "giuseppe", "pino": "giuseppe", "peppino": "giuseppe", "geppi": "giuseppe", "giusy": "giuseppina", "pina": "giuseppina", "giusi": "giuseppina", "memo": "guglielmo", "gu": "guglielmo", "ila": "ilaria", "nardo": "leonardo", "leo": "leonardo",
    "renzo": "lorenzo", "lori": "loredana lorenzo", "dana": "loredana", "lory": "loredana", "vica": "ludovica", "vico": "ludovico", "ludo": "ludovico ludovica", "gigi": "luigi", "gino": "luigi", "lena": "maddalena", "magda": "maddalena",
    "marghe": "margherita", "rita": "margherita rita", "meg": "margherita", "michi": "michelangelo", "miche": "michelangelo", "angelo": "michelangelo", "patty": "patrizia", "patti": "patrizia", "lello": "raffaele", "raf": "raffaele", "raffa": "raffaella",
    "ricky": "riccardo", "ricki": "riccardo", "roby": "roberta roberto", "robi": "roberto roberta", "berta": "roberta", "berto": "roberto umberto", "lia": "rosalia", "rosy": "rosalia rosa", "totò": "salvatore", "toto": "salvatore", "turi": "salvatore",
    "salvo": "salvatore", "resi": "teresa", "tere": "teresa", "maso": "tommaso", "tommy": "tommaso", "tom": "tommaso", "bertino": "umberto", "umbi": "umberto", "enza": "vincenza", "enzo": "vincenzo lorenzo", "cenzo": "vincenzo", "vale": "valerio valentina",
    "ste": "stefano", "simo": "simone simona", "pat": "patrizia", "teo": "matteo", "gen": "gennaro", "nico": "nicola", "sabri": "sabrina", "silvietta": "silvia", "totuccio": "salvatore", "marietto": "mario", "mari": "maria", "tommi": "tommaso", "bia": "beatrice",
}
TRADES = (
    "azienda vinicola", "azienda agricola", "studio tributario associato", "studio legale", "laboratorio analisi", "officine meccaniche", "consorzio di bonifica", "caseificio sociale", "cooperativa agricola", "camera arbitrale",
    "istituto comprensivo", "unione dei comuni", "impresa edile", "farmacia", "immobiliare", "tribunale", "autotrasporti", "comune", "banca", "condominio", "associazione",
)
_SMALL = set("di dei del della delle dell da de la il lo le e ed con per gli al".split())
_WORD = re.compile(r"[^\W\d_]+(?:·[^\W\d_]+)?(?:'(?=\w))?")
_CONTRACTED = re.compile(r"(?<![\w.])([^\W\d_]+)\.([^\W\d_]{2,3}|[aeo](?![\w.]))\b\.?")


def edit1(a: str, b: str) -> bool:
    """Whether a and b differ by at most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the two lengths, by bit vectors."""
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = (v + u | v - u) & full
    return 2.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


@lru_cache(maxsize=100_000)
def givens(token: str) -> tuple[str, ...]:
    """The given names that a token may stand for: itself, a short form, an initial, a prefix or a typing error."""
    if token in _GIVEN:
        return (token,)
    if token in SHORT:
        return tuple(SHORT[token].split())
    if len(token) == 1:
        return tuple(g for g in GIVEN if g[0] == token)
    if "·" in token:
        a, b = token.split("·")
        return tuple(g for g in GIVEN if g.startswith(a) and g.endswith(b))
    if starts := tuple(g for g in GIVEN if g.startswith(token)):
        return starts
    near = tuple(g for g in GIVEN if len(token) > 3 and edit1(token, g))
    if near:
        return near
    return tuple(x for s, gs in SHORT.items() if len(token) > 4 and edit1(token, s) for x in gs.split())


_GIVEN = frozenset(GIVEN)


def _rank(token: str) -> int:
    """How surely a token is a given name; 0 is not."""
    if token in _GIVEN:
        return 5
    if token in SHORT:
        return 4
    if len(token) == 1:
        return 3
    if not givens(token):
        return 0
    return 1 if len(token) > 3 and any(edit1(token, g) for g in givens(token)) else 2


def _matches(token: str, word: str) -> bool:
    if "·" in token:
        a, b = token.split("·")
        return word.startswith(a) and word.endswith(b)
    return token == word or (len(token) >= 2 and word.startswith(token)) or (len(token) >= 6 and word.endswith(token)) or (len(token) >= 5 and edit1(token, word))


def _trades(tokens: list[str]) -> tuple[list[str], list[str]]:
    """(trades that the tokens may name, tokens left over)."""
    best: list[str] = []
    left: list[str] = tokens
    covered = 0
    for phrase in TRADES:
        words = [w for w in phrase.split() if w not in _SMALL]
        rest, hit = list(tokens), 0
        for w in words:
            at = next((t for t in rest if t not in _SMALL and len(t) > 1 and _matches(t, w)), None)
            if at is None:
                break
            rest.remove(at)
            hit += 1 if len(at) > 1 else 0
        if hit < len(words):
            letters = [t for t in tokens if len(t) == 1]
            if len(words) > 1 and letters and "".join(letters) == "".join(w[0] for w in words):
                rest, hit = [t for t in tokens if len(t) > 1], len(words)
            else:
                continue
        rest = [t for t in rest if t not in _SMALL]
        if not any(len(t) >= 4 for t in rest):
            continue
        size = sum(len(w) for w in words) if hit == len(words) else 0
        exact = sum(t in words for t in tokens)
        score = 10 * hit + exact
        if score > covered:
            best, left, covered = [phrase], rest, score
        elif score == covered and size:
            best.append(phrase)
    return best, left


def parse(value: str) -> tuple[str, str, list[str], int]:
    """(kind, core, partners, sure) of one typed name; kind is person, org or other.

    ``sure`` is 1 where the partner is spelled out, so that the value vouches for an entity.
    """
    s = re.sub(r"(?<=[a-zà-ÿ]{3})(?=[A-Z][a-zà-ÿ])", " ", unicodedata.normalize("NFKC", value)).casefold()
    nick = re.search(r'["“”«»\'](\w{2,})["“”«»\']', s)
    s = re.sub(r'["“”«»].*?["“”«»]|\([^)]*\)', " ", s)
    parts = [p for p in re.split(r"\s+[-–|/]\s+", s) if p.strip()]
    kept = [p for p in parts if not (w := _WORD.findall(p)) or not any(w[0] == o or (len(w[0]) > 4 and edit1(w[0], o)) for o in OFFICES)]
    s = " ".join(kept or parts)
    s = re.sub(r"&\s*c\b\.?|\be\s+c\.|&\s*figli|\be figli\b", " ", s)
    legal = bool(LEGAL.search(s))
    if legal:
        s = LEGAL.sub(" ", s)
    s = re.sub(r"\b(dott|dr|prof|sig)\.?\s?(ssa|ra)\b\.?", r"\1", s)
    s = _CONTRACTED.sub(lambda m: m.group() if m.group(2) in _SMALL else f"{m.group(1)}·{m.group(2)} ", s)
    tokens = [t for t in _WORD.findall(s) if t not in TITLES]
    trades, rest = _trades(tokens)
    if trades and not (not legal and len(tokens) == 2 and any(_rank(t) >= 5 for t in tokens)):
        core = max(rest, key=lambda t: (len(t), t))
        return "org", core, trades, int(len(trades) == 1)
    words = [t for t in tokens if t not in _SMALL or (len(tokens) == 2 and len(t) == 1)]
    if legal and words:
        return "org", max(words, key=lambda t: (len(t), t)), [" ".join(sorted(words))], 1
    if len(words) < 2:
        return "other", " ".join(sorted(words)) or s.strip(), [], 0
    longest = max(range(len(words)), key=lambda k: (len(words[k]) if _rank(words[k]) < 4 else 0, k))
    ranks = [(_rank(t) if k != longest else 0) for k, t in enumerate(words)]
    first = max(range(len(words)), key=lambda k: (ranks[k] > 0, min(ranks[k], 4) if ranks[k] != 3 else 2, -k))
    if ranks[first] == 0:
        return "person", words[longest], [words[0] if longest else words[-1]], 0
    names = list(givens(words[first]))
    if nick and len(names) > 1:
        names = [g for g in names if g in givens(nick.group(1))] or names
    return "person", words[longest], names, int(ranks[first] == 5)


_PARSED = "kind string, core string, partners array<string>, sure int"


def _parse_values(df: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            yield pd.concat([b, pd.DataFrame([parse(v) for v in b["value"]], columns=["kind", "core", "partners", "sure"], index=b.index)], axis=1)

    return df.mapInPandas(run, "value string, " + _PARSED)


def _keys(cores: DataFrame) -> DataFrame:
    """Suffix keys of every core, of the word and of its reversal, no shorter than half of it."""
    n = F.length("core")
    half = F.greatest(F.lit(3), F.floor((n - 1) / 2).cast("int"))
    # an error changes the length by one at most: suffixes of this and the next smaller half meet
    sizes = F.array_distinct(F.array(half, F.greatest(F.lit(3), half - 1)))
    both = F.array(
        F.transform(sizes, lambda k: F.concat(F.lit(">"), F.substring("core", n - k + 1, k))),
        F.transform(sizes, lambda k: F.concat(F.lit("<"), F.substring("core", F.lit(1), k))),
    )
    return cores.select("*", F.explode(F.array_distinct(F.flatten(both))).alias("key"))


def _deletion_keys(cores: DataFrame) -> DataFrame:
    """The core itself and the core without one letter: any two cores one error apart share a key."""
    without = F.transform(F.sequence(F.lit(1), F.length("core")), lambda i: F.concat(F.substring("core", F.lit(1), i - 1), F.substring("core", i + 1, F.length("core"))))
    return cores.withColumn("key", F.explode(F.array_distinct(F.concat(F.array(F.col("core")), without))))


def least_ratio(n: int, least: float = 0.8) -> float:
    """The ratio from which cores are alike, the longer one of ``n`` letters: one letter may always differ from 4 letters on."""
    return min(least, 1 - 1 / n) if n >= 4 else least


def alike(a: str, b: str, least: float = 0.8) -> bool:
    """Whether two cores may be spellings of one: by the ratio, with lengths at most two letters apart."""
    return abs(len(a) - len(b)) <= 2 and lcs_ratio(a, b) >= least_ratio(max(len(a), len(b)), least) - 1e-9


def rests(rest: str, size: int, least: float = 0.8) -> list[str]:
    """What is left of a core of ``size`` letters outside its suffix, without any letters that an alike one may lack."""
    # with b at most two letters shorter, a lacks at most (1 - least) * len(a) + least letters
    cut = min(len(rest), max(1, int((1 - least) * size + least + 1e-9)))
    return sorted({"".join(rest[i] for i in keep) for k in range(cut + 1) for keep in combinations(range(len(rest)), len(rest) - k)})


def _refined(keyed: DataFrame, least: float) -> DataFrame:
    """Rows of common suffixes with one refined key for each rest."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            cut = [rests(c[: 1 - len(k)] if k[0] == ">" else c[len(k) - 1 :], len(c), least) for c, k in zip(b["core"], b["key"], strict=True)]
            b["key"] = [[k + "|" + r for r in rs] for k, rs in zip(b["key"], cut, strict=True)]
            yield b.explode("key")

    return keyed.mapInPandas(run, keyed.schema)


def _compare(pairs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            ratio = [lcs_ratio(x, y) if alike(x, y, least) else -1.0 for x, y in zip(b["a"], b["b"], strict=True)]
            yield b.assign(ratio=ratio)[[r >= 0 for r in ratio]]

    return pairs.mapInPandas(run, "kind string, partner string, a string, b string, ratio double")


def _followed(moved: DataFrame) -> DataFrame:
    """Corrections followed to their end; each one goes to a better core, so that there is no circle."""
    while True:
        again = moved.select("kind", "partner", F.col("core").alias("to"), F.col("to").alias("to2"))
        longer = moved.join(again, ["kind", "partner", "to"], "left").select("kind", "partner", "core", F.coalesce("to2", "to").alias("to"), F.col("to2").isNotNull().alias("went"))
        longer = checkpoint(longer)  # the paths double in length: few rounds
        if longer.where("went").isEmpty():
            return longer.drop("went")
        moved = longer.drop("went")


def link(values: DataFrame, vouched: DataFrame, seen_with: DataFrame, common: int = 300, least: float = 0.8) -> DataFrame:
    """(value, entity) for every distinct value.

    ``values`` has the column value (distinct, not null); ``vouched`` has the column core: tokens
    known to be spelled right (from addresses); ``seen_with`` has (value, partner): a given name seen
    in an address used with the value. ``common`` is the block size from which deletion keys replace
    suffixes; cores of up to 6 letters have them at every size. A value that cannot be parsed is its own entity.
    """
    parsed = _parse_values(values.select("value"))
    parsed = parsed.join(vouched.select("core").distinct().withColumn("_ok", F.lit(1)), "core", "left").withColumn("ok", F.coalesce("_ok", F.lit(0))).drop("_ok")
    # distinct values only: each stage is cut off, or the self joins would repeat all before them
    parsed = checkpoint(parsed)
    long = parsed.select("value", "kind", "core", "sure", "ok", F.explode("partners").alias("partner"))
    cores = long.groupBy("kind", "core", "partner").agg(F.count(F.lit(1)).alias("n"), F.max("ok").alias("ok"), F.max("sure").alias("sure"))
    cores = checkpoint(cores.where(F.col("kind") != "other"))
    # 6 letters have both kinds of keys: deletions for 5 and 6 letters, suffixes for 7
    keyed = _keys(cores.where(F.length("core") >= 6))
    block = ["kind", "partner", "key"]
    sized = keyed.groupBy(*block).agg(F.count(F.lit(1)).alias("size"))
    keyed = checkpoint(keyed.join(sized.where(F.col("size") > 1), block))
    columns = [*cores.columns, "key"]
    rare = keyed.where(F.col("size") <= common).select(*columns)
    refined = _refined(keyed.where(F.col("size") > common).select(*columns), least)
    # too short for a suffix to be whole
    short = _deletion_keys(cores.where(F.length("core") <= 6)).select(*columns)

    def meet(k: DataFrame) -> DataFrame:
        cols = ["kind", "partner", "key"]
        a = k.select(*cols, F.col("core").alias("a"), F.col("n").alias("na"), F.col("ok").alias("oka"))
        b = k.select(*cols, F.col("core").alias("b"), F.col("n").alias("nb"), F.col("ok").alias("okb"), F.col("sure").alias("sureb"))
        better = (F.col("okb") > F.col("oka")) | ((F.col("okb") == F.col("oka")) & ((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))))
        return a.join(b, cols).where((F.col("oka") == 0) & (F.col("a") != F.col("b")) & better & (F.abs(F.length("a") - F.length("b")) <= 2))

    cols = ["kind", "partner", "a", "b", "okb", "nb", "sureb"]
    met = checkpoint(meet(rare).select(*cols).union(meet(refined).select(*cols)).union(meet(short).select(*cols)).distinct())
    near = _compare(met.select("kind", "partner", "a", "b").distinct(), least).join(met, ["kind", "partner", "a", "b"])
    best = checkpoint(near).groupBy("kind", "a", "partner").agg(F.max_by("b", F.struct("okb", "sureb", "nb", "ratio", F.col("b"))).alias("b"))
    moved = _followed(checkpoint(best.select("kind", "partner", F.col("a").alias("core"), F.col("b").alias("to"))))
    # each reading (core as corrected under a partner) of each value
    readings = checkpoint(long.join(moved, ["kind", "partner", "core"], "left").select("value", "kind", "sure", "partner", F.coalesce("to", "core").alias("core"), "ok", F.col("to").isNotNull().alias("fixed")))
    vouch = readings.where(F.col("sure") == 1).select("kind", "partner", "core").distinct().withColumn("known", F.lit(1))
    hints = seen_with.select("value", "partner").distinct().withColumn("hint", F.lit(1))
    judged = readings.join(vouch, ["kind", "partner", "core"], "left").join(hints, ["value", "partner"], "left")
    weight = 4 * F.coalesce("hint", F.lit(0)) + 2 * F.coalesce("known", F.lit(0)) + F.when(F.col("fixed"), 0).otherwise(1)
    w = Window.partitionBy("value")
    judged = judged.withColumn("weight", weight).withColumn("top", F.max("weight").over(w)).where(F.col("weight") == F.col("top"))
    judged = judged.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("kind", "core", "partner")).alias("at"), F.min("top").alias("top"))
    one = F.col("n") == 1
    sorted_at = F.array_sort("at")
    entity = F.when(one, F.to_json(F.element_at("at", 1))).otherwise(F.to_json(sorted_at))
    whole = parsed.select("value", "kind", "core").join(judged.select("value", entity.alias("entity")), "value", "left")
    alone = F.when(F.col("core") != "", F.concat(F.lit("="), F.col("kind"), F.lit(":"), F.col("core"))).otherwise(F.concat(F.lit("=:"), F.col("value")))
    return whole.select("value", F.coalesce("entity", alone).alias("entity"))


def entities(df: DataFrame, names: tuple[str, ...] = ("from_name", "client"), address: str = "from_addr") -> DataFrame:
    """(value, entity): every typed value and a key that all spellings of one person or organisation share.

    Null, empty and address-like values (with @) are no values; repeated rows count once; values are
    compared and returned exactly as stored.
    """
    listed = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in names])).alias("value"))
    values = listed.where(F.col("value").isNotNull() & (F.col("value") != "") & ~F.contains("value", F.lit("@"))).distinct()
    parts = F.split(F.lower(F.col(address).cast("string")), r"[@.+_\-\d]+")
    addressed = df.select(F.col(names[0]).cast("string").alias("value"), parts.alias("parts")).distinct()
    tokens = addressed.select(F.explode("parts").alias("t")).where(F.length("t") > 4).distinct()
    vouched = tokens.select(F.explode(F.array(F.col("t"), F.expr("substring(t, 2)"))).alias("core")).where(F.length("core") > 4)
    # short cores: the whole part of an address, or what follows the initial of a word of the name used with it
    brief = addressed.select(F.concat(F.lit(" "), F.lower("value")).alias("named"), F.explode("parts").alias("t")).where(F.length("t").between(2, 5))
    led = brief.where(F.contains("named", F.concat(F.lit(" "), F.substring("t", 1, 1)))).select(F.expr("substring(t, 2)").alias("core"))
    vouched = vouched.union(brief.select("t").where(F.length("t") < 5)).union(led.where(F.length("core") > 1)).distinct()
    seen = addressed.where(F.col("value").isNotNull()).select("value", F.explode("parts").alias("partner")).where(F.col("partner").isin(*GIVEN)).distinct()
    # an address that several writers share says nothing certain: keep a hint only where it is the value's only one
    only = Window.partitionBy("value")
    seen = seen.withColumn("_n", F.count(F.lit(1)).over(only)).where(F.col("_n") == 1).drop("_n")
    return link(values, vouched, seen)


def members(df: DataFrame, names: tuple[str, ...] = ("from_name", "client"), address: str = "from_addr") -> DataFrame:
    """(name, representative): each typed value and the smallest spelling, in byte order, of whom it means; grows with the values only."""
    linked = checkpoint(entities(df, names, address))
    smallest = linked.groupBy("entity").agg(F.min("value").alias("representative"))
    return linked.join(smallest, "entity").select(F.col("value").alias("name"), "representative")


def variants(df: DataFrame, names: tuple[str, ...] = ("from_name", "client"), address: str = "from_addr") -> DataFrame:
    """(name_a, name_b): each pair of different typed values that mean the same, name_a the smaller in byte order; see ``entities``."""
    linked = checkpoint(entities(df, names, address))
    a = linked.select("entity", F.col("value").alias("name_a"))
    b = linked.select("entity", F.col("value").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
