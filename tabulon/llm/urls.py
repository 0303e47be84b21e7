"""URL filters: explicit rules, and a logistic regression on hashed character n-grams for all other URLs.

The regression is trained on a small labelled table of URLs, made by rule from names of unwanted and ordinary kinds of sites and the words
that stand beside them.  Features are the hashed n-grams of the host
(in `^host/`) and of the path, each in its own half of the feature space, scaled to unit length per URL.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

# Rules (host and path, verdict), as the contract gives them.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

#: Names of sites of unwanted kinds (gambling, pornography, pills, loans, piracy, fraud, link selling), and words that stand beside them.
UNWANTED = """
    gambling poker roulette blackjack baccarat betting bookmaker wager lottery lotto jackpot slots bingo keno scratchcard sportsbook
    croupier dice highroller punter tote sweepstake highstakes pokies craps
    porn porno xxx nude nudes naked erotic erotica sex sexy hentai milf fetish bdsm camgirl camgirls escort escorts hookup swinger swingers
    stripper lingerie horny slut singles sugardaddy onenight livecam peepshow upskirt playmate hardcore
    viagra cialis levitra tramadol xanax valium oxycodone steroids anabolic slimming fatburner weightloss detoxtea testosterone botox
    antidepressants sildenafil modafinil painkillers hgh enlargement hairgrowth miraclecure
    payday loans lender cashadvance quickcash debt creditrepair refinance forex binaryoptions cryptoprofit bitcoin doubler pyramid hyip
    getrich passiveincome millionaire moneymaker earnings giveaway giftcards prizes surveys reward claims
    warez crack cracked keygen serials torrent torrents pirate pirated nulled rips iptv streamz camrip modapk cheats aimbot unlocker
    phishing malware trojan exploit botnet carding fullz stealer hijack popunder popups clickbait clickfraud redirector scam fake replica
    replicas knockoff counterfeit backlinks linkbuilding seoboost followers likes traffic autosurf proxybuy leads bulkmail mailer
    essaywriter diplomas passports psychic astrology fortune lovespell
"""
UNWANTED_WITH = """
    online bonus live hot best vip club hd tube deals discount buy order now instant 247 365 pro royal mega lucky palace zone hub nation
    guaranteed daily secret real top big super express kingdom cash money pics videos girls tonight market outlet sale rx meds download
"""
#: Names of ordinary sites, and words that stand beside them.
ORDINARY = """
    museum library school university college academy institute laboratory observatory archive gallery theatre orchestra choir opera cinema
    newspaper herald gazette journal magazine press publisher bookshop poetry novel fiction history archaeology geology botany zoology
    physics chemistry biology mathematics statistics astronomy medicine hospital clinic dentist nursing pharmacology surgery pediatrics
    psychology sociology philosophy theology linguistics grammar dictionary translation language english french german spanish italian
    council parliament ministry embassy court police firefighters mayor election democracy freedom justice rights charity volunteers
    weather climate ocean river mountain forest meadow valley island harbour lighthouse canal bridge railway station airport bicycle
    hiking climbing sailing rowing swimming running football cricket rugby tennis hockey skiing winter summer autumn spring olympic
    garden orchard vineyard bakery brewery coffee teahouse kitchen recipes cooking cheese bread soup vegetables dairy butcher restaurant
    cafe hotel hostel camping travel tourism guide map atlas heritage castle cathedral village town district neighbourhood square
    carpenter plumber electrician builder architect engineer mechanic welding pottery weaving knitting sewing quilting tailor jeweller
    furniture lamps textiles paper printing stationery bookbinding calligraphy painting sculpture photography camera film music piano
    violin guitar drums jazz folk concert festival dance ballet puppets circus toys puzzles chess boardgames gardeners birdwatch
    insects butterfly whale dolphin horse sheep goat puppy kitten veterinary aquarium wildlife nature conservation recycling energy
    solar windmill battery computing software compiler kernel database network protocol python javascript linux hardware robotics
    electronics telescope microscope satellite rocket planet moon comet geography census economics finance accounting insurance bank
    pension taxes lawyer notary consumer standards patents science research engineering technology innovation report policy review
    parents children family grandmother baby kindergarten teacher student homework exam lecture seminar thesis scholarship alumni
    church mosque synagogue temple monastery parish community neighbours society league federation union guild committee association
    watch clock season calendar diary letters postcards memory stories legends folklore fable myth founders pioneers veterans
    trader trackless adapter address admiral bettering alphabet pillar pillow cheaper sexton essex analyst cocktail assembly classic
    passage grass brass scunthorpe therapist expert exchange explore express extra titan hotplate password debate debut loan-library
    handbook scrapbook tournament slotcar coinage minted lotus diceware rewarding crackers cracklin pirateship fakir likeness leader
    trafficlight mailbox hubcap tubes nudge escorted hookworm claimant prizewinner
"""
ORDINARY_WITH = """
    city county national royal public local old new north south east west river lake hill green blue little great open free-time young
    notes news today weekly review guide center house group team works studio shop store club market school park street
    society project foundation teaching family valley trust press friends world life home
"""
_FRONTS, _ENDS = ("", "www.", "", "m.", "blog.", "en."), (".com", ".net", ".org", ".info", ".example.com", ".example.net", ".co.uk", ".de", ".fr", ".biz")
_PATHS = ("/", "", "/en/12", "/fr/581.html", "/de/7/", "/es/40?page=2", "/index.html", "/about", "/2021/05/a-day-out", "/item?id=3", "/search?q=one", "/en/news/1959.html")
#: Sites made of each name.
_SITES = 6
#: Names without a meaning among the ordinary ones.
_INVENTED = 80


def invented_names(n: int, seed: int = 0) -> str:
    """Names without a meaning, of two to four syllables: what says nothing is ordinary."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfghjklmnpqrstvwxyz") + r.choice("aeiouy") + r.choice(("", "", "n", "r", "s", "q")) for _ in range(r.randint(2, 4))) for _ in range(n))


def labelled_sites(names: str, beside: str) -> list[str]:
    """URLs of sites made of each name: the name alone, and before or after words that stand beside it.  Front names, endings and paths go round,
    in the same way for every label, so they say nothing."""
    found, words = [], beside.split()
    for i, name in enumerate(names.split()):
        for k in range(_SITES):
            other = words[(5 * i + 11 * k) % len(words)]
            host = (name, f"{name}-{other}", f"{other}{name}", f"{other}-{name}", f"{name}{other}", f"the-{name}")[k]
            found.append(f"http://{_FRONTS[(i // 2 + k) % len(_FRONTS)]}{host}{_ENDS[(i + k) % len(_ENDS)]}{_PATHS[(i + i // 12 + 2 * k) % len(_PATHS)]}")
    return found


#: The labelled table.
LABELLED = {"block": " ".join(labelled_sites(UNWANTED, UNWANTED_WITH)), "allow": " ".join(labelled_sites(ORDINARY + invented_names(_INVENTED), ORDINARY_WITH))}

#: Character n-gram lengths, and hashed features for each of host and path.
LENGTHS = (3, 4, 5)
FEATURES = 1 << 16
EPOCHS, RATE, PENALTY = 600, 40.0, 1e-5
#: A URL without a rule is blocked from this probability on.
BLOCK_FROM = 0.4
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def split_url(url):
    """Columns (host with A-Z folded, path) of a URL column; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(tail, F.lit(""))


def matching_rule(host, path, rules: dict[str, str]):
    """The longest rule whose host is this host or a parent domain of it, and whose path the path starts with."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashed features and values of all URLs: each row's distinct features, scaled to unit length."""
    keys, n = [np.empty(0, np.int64)], len(hosts)
    framed = pc.binary_join_element_wise(pa.scalar("^"), hosts.fill_null(""), pa.scalar("/"), pa.scalar(""))
    for half, texts in enumerate((framed, paths.fill_null(""))):
        col = tk.column(texts)
        raw, owner = col.data.astype(np.uint64), np.repeat(np.arange(n), np.diff(col.offsets))
        for k in LENGTHS:
            m = len(raw) - k + 1
            if m > 0:
                h = np.full(m, k, np.uint64)
                for j in range(k):
                    h = (h + raw[j : m + j] + np.uint64(1)) * _MULTIPLIER
                    h ^= h >> np.uint64(29)
                within = owner[:m] == owner[k - 1 :]
                slot = (h[within] % np.uint64(FEATURES)).astype(np.int64) + half * FEATURES
                keys.append(owner[:m][within] * (2 * FEATURES) + slot)
    found, count = np.unique(np.concatenate(keys), return_counts=True)
    row = found // (2 * FEATURES)
    length = np.sqrt(np.bincount(row, count.astype(float) ** 2, n))
    return row, found % (2 * FEATURES), count / length[row]


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    return rest[:cut].lower(), tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


def train(labelled: dict[str, str]) -> np.ndarray:
    """Weights of the regression (the last one is the constant), by full gradient steps."""
    urls = [(*_parts(url), float(label == "block")) for label, every in sorted(labelled.items()) for url in every.split()]
    row, slots, values = features(pa.array([host for host, _, _ in urls], pa.string()), pa.array([path for _, path, _ in urls], pa.string()))
    used, at = np.unique(slots, return_inverse=True)
    y, w, bias = np.array([label for _, _, label in urls]), np.zeros(len(used)), 0.0
    for _ in range(EPOCHS if len(y) else 0):
        apart = (1 / (1 + np.exp(-np.bincount(row, w[at] * values, len(y)) - bias)) - y) / len(y)
        w -= RATE * (np.bincount(at, apart[row] * values, len(w)) + PENALTY * w)
        bias -= RATE * 0.09 * apart.sum()
    out = np.zeros(2 * FEATURES + 1)
    out[used], out[-1] = w, bias
    return out


def filter_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: dict[str, str] | None = None, labelled: dict[str, str] | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (probability that the model gives to block).

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, the path from there to ``?``, ``#`` or the end; null
    and URLs without ``://`` have neither, no rule fits them, and the model judges the empty host and path.
    The longest fitting rule decides, else the model.  Repeated rows are judged each on its own; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    weights = pages.sparkSession.sparkContext.broadcast(train(LABELLED if labelled is None else labelled))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = split_url("url")
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = weights.value[:-1], weights.value[-1]
        for batch in batches:
            row, slots, values = features(batch.column(1), batch.column(2))
            score = 1 / (1 + np.exp(-(np.bincount(row, w[slots] * values, batch.num_rows) + bias)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "score"])

    judged = rows.mapInArrow(judge, "page_id long, host string, path string, rule string, score double")
    verdict = F.when(F.col("score") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))
    for rule, decided in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(decided)).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
