"""Problem 1: one person or organisation under many spellings.

Method: names are brought to tokens (accents, case, titles, order, legal forms and abbreviations aside) and equal
sorted tokens are one node. Nodes are blocked by phonetic codes of their sorted tokens, compared with Jaro-Winkler
and the nickname table, and accepted pairs are clustered by connected components. Names that give only a part
(surname, initial and surname, firm without its kind) are no nodes: they join the one cluster that they fit, in the
whole corpus or else in their own article, and stay apart if several fit.

All work is on distinct names; the mentions themselves are joined back last, so a name that a third of all rows
hold is one row until then.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadloom.llm.components import connected_components
from threadloom.operators.blocks import pairs_within, spread_join
from threadloom.session import StageTables

# Forms of one given name; the first stands for all.
GIVEN_NAMES = """
alexander alex sasha alec xander sandy aleksandr alejandro alexandre; michael mike mick mikhail michel miguel mikael; robert rob bob bobby bert roberto;
william bill will billy willy liam guillermo guillaume wilhelm; richard rick dick rich ricardo; james jim jimmy jamie; joseph joe jo josef joey; john jon johnny;
johannes hans johann hannes; thomas tom tommy tomas; daniel dan danny; daniela dani; benjamin ben benny benji; samuel sam sammy; nicholas nick nicolas nico klaas nicky;
nikolai kolya nikolay nicolai; christopher chris kris kit christoph; theodore ted teddy theo theodor; frederick fred freddy fritz friedrich frederic; gregory greg gregor grigory;
gabriel gabe gabriele; victor vic viktor; vikram vik; matthias matt mathias matthew mats; maximilian max maxim maximillian; leopold leo poldi; ludwig lutz ludo; harold harry hal;
edgar ed eddie; gerhard gerd gert; rafael raf rafa raphael; francisco paco pancho frank; jose pepe; enrique quique henri; henrik rik hendrik henry; esteban steve; stefan stephan steffen stephen stefano;
alberto beto albert; manuel manolo manny; pablo paul; anton toni tony antonio; anatol tolya anatole anatoly; dmitri dima dimitri dmitry mitya; sergei sergey serge seryozha; ivan vanya iwan;
pavel pasha; boris borya; yusuf yousef youssef yusef; mohamed mohammed muhammad mohammad mo; ibrahim ibraheem ebrahim; farid fareed; jamal gamal jamaal; karim kareem; malik maleek;
elizabeth liz beth betty eliza lizzie elisabeth lisa elsbeth; margaret maggie meg peggy margarete marge margarita; katherine kate kathy katie katharine catherine catharine katrin; patricia pat patty trish;
dorothy dot dottie dora dorothea dolly; rebecca becky becca rebekah; susanna susan sue suzy susie suzanna susana; valentina valya valentine; tatiana tanya tatyana tania; natalia natasha natalya nata nathalie;
isabella bella isa isabel izzy isabelle; magdalena magda madeleine; helena helen hella; elena lenochka yelena ellen; julia julie yulia giulia jule; dolores lola; lucia lucy luz lucie lucija;
kamila camila camilla kamilla; camille cam; ursula uschi ursel ulla; judith judy jude; esther essie ester; tamara tammy toma; amelie amy amelia; beatriz bea beatrix beatrice; cecilia cissy cecily cecile celia;
gloria glory; josephine josie; jasmin jasmine yasmin yasmine; sofia sophia sophie sonia sofie sofya; zoe zoey zoie; irina ira irene iryna; olga olya; nadia nadja nadya nadezhda; nora eleonora norah; ingrid inga;
agnes aggie agnieszka; andrea andi; adrian ade adrien; laurent lawrence larry laurence; olivier oliver ollie; philippe phil philip filip; jacques jack; rene renee; cyril kirill cyrill; oskar oscar; felix lix; emil emile;
jonas jonah; bruno brun; hugo hugh; gunnar gunner; arjun arjuna; sanjay sanju; ravi ravindra; kenji ken; diego iago; rosa rosie rosita; marta martha; marie mary maria; carla karla; clara klara claire; erika erica; hana hanna hannah; ines inez; fiona fi;
petra pet; anita ann; milena mila; naomi noemi; priya pri; deepa dipa; lakshmi laxmi; emeka chukwuemeka; kwame kwami; chidi chidiebere; rudiger rudi rudy ruediger; klaus claus nicklaus; dagmar dagi daga; amara mara; astrid asta; leila layla leyla; aisha ayesha
"""
# Short forms that several given names share.
SHARED = {"lena": ("magdalena", "helena", "elena"), "tina": ("valentina", "martina", "christina"), "betty": ("elizabeth", "beatriz"), "al": ("alberto", "alexander"), "maggie": ("margaret", "magdalena"),
          "greta": ("margaret", "greta"), "dora": ("dorothy", "theodora"), "sandy": ("alexander", "sandra"), "nico": ("nicholas", "nikolai"), "chris": ("christopher", "christian"), "ella": ("elena", "isabella")}
# Words before a personal name, particles of surnames, legal forms and words that a firm's name may lack.
TITLES = set(
    "dr prof professor mr mrs ms miss hon sir dame lord lady minister amb ambassador sen senator gov governor president pres rep gen general col capt captain judge justice rev chancellor secretary mayor "
    "premier chairman chairwoman chair director ceo herr frau mme mlle monsieur madame sr sra srta don doña dona señor señora representative congressman deputy prime commissioner envoy spokesperson".split()
)
PARTICLES = set("de da di do del della dos du la le van von der den ten ter al el bin ibn ben o mac mc st".split())
LEGAL = set("inc incorporated ltd limited plc ag gmbh corp corporation co company llc llp lp sa sas sarl nv bv spa srl kg se oy ab as pty sons son the of and und et y e & der die das la le el los".split())
# Usual short forms of words in firms' names.
SHORT = dict(
    x.split(":")
    for x in "intl:international int:international natl:national ins:insurance insur:insurance inst:institute hldgs:holdings hldg:holdings grp:group ptnrs:partners ptrs:partners dev:development devt:development auth:authority sys:systems shpg:shipping ship:shipping "
    "wks:works engy:energy enrg:energy res:research rsch:research tel:telecom tele:telecom telco:telecom netwks:networks netwk:networks ntwks:networks ntwk:networks net:networks nets:networks nwks:networks bk:bank bnk:bank fdn:foundation fndn:foundation found:foundation assn:association assoc:association "
    "svcs:services svc:services tech:technology mfg:manufacturing mgmt:management ind:industries inds:industries univ:university dept:department govt:government comm:commission cncl:council ctr:center arpt:airport apt:airport hlth:health wtr:water stl:steel fds:foods lns:lines rl:rail".split()
)
CODES = {c: d for d, cs in enumerate(("bfpvw", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}
#: A word is part of many firms' names, not a name of its own, if it stands behind this share of the different first words; so at most
#: the words of a name / share are, and at least so many first words.
GENERIC_SHARE, MIN_FIRSTS = 0.01, 4
#: Letters from which one edit in a token that goes with one other token only is a misspelling, however often it is written.
LONG = 7


@functools.cache
def _given() -> dict[str, str]:
    return {n: c.split()[0] for c in GIVEN_NAMES.replace("\n", " ").split(";") for n in c.split() if n not in SHARED}


def skeleton(token: str) -> str:
    """Phonetic code of a token, not cut off: classes of its consonants, runs as one; vowels, h and y part runs."""
    out, last = [], 0
    for ch in token:
        code = CODES.get(ch, 0)
        if code and code != last:
            out.append(str(code))
        last = code
    return "".join(out)


def plain(text: str) -> str:
    t = unicodedata.normalize("NFKD", text)
    t = "".join(c for c in t if not unicodedata.combining(c))
    return t.translate({0x2019: "'", 0x2018: "'", 0xA0: " ", 0xDF: "ss", 0xF8: "o", 0xD8: "O", 0x142: "l", 0x141: "L", 0xE6: "ae", 0x111: "d"})


def parse_person(text: str) -> tuple[str, list[str], str, bool]:
    """(kind, tokens, initial, sure): kind is full (two tokens: given name class and surname), initial, surname or none."""
    t = re.sub(r"(?<=[a-z])(?=[A-Z])(?<!\bMc)(?<!\bMac)(?<!\bO)", " ", plain(text))
    t = re.sub(r"(?<=[A-Za-z])'(?=[A-Za-z])", "", t)
    t = re.sub(r"(?<=[a-z.])(?=(?:al|el)-[ ]?[A-Z])", " ", t)
    t = re.sub(r"\b(al|el|bin)[- ](?=\w)", r"\1-", t, flags=re.I)
    sure = "," in t
    if sure:
        last, _, first = t.partition(",")
        if first.strip():
            t = first + " | " + last
    words: list[str] = []
    held = ""
    for w in re.findall(r"[a-z]+(?:-[a-z]+)*|\|", t.lower()):
        if w == "|":
            words.append(w)
        elif w in TITLES and not held and all(x == "|" for x in words):
            continue
        elif w in PARTICLES and len(w) > 1:
            held += w
        else:
            words.append(held + w.replace("-", ""))
            held = ""
    if held:
        words.append(held)
    front, bar, back = (words[: words.index("|")], True, words[words.index("|") + 1 :]) if "|" in words else (words, False, [])
    front = [w for w in front if w not in TITLES] if bar else front
    long_front, initials = [w for w in front if len(w) > 1], [w for w in front if len(w) == 1]
    if bar:
        surname = "".join(w for w in back if len(w) > 1)
        given = long_front[0] if long_front else ""
        initial = initials[0] if initials and not given else ""
    elif len(long_front) >= 2:
        given, surname, initial = long_front[0], long_front[-1], ""
    else:
        given, surname = "", long_front[0] if long_front else ""
        initial = initials[0] if initials else ""
    if not surname:
        return "none", [], "", False
    if given:
        return "full", [_given().get(given, given), _given().get(surname, surname)], "", bar
    return ("initial" if initial else "surname"), [surname], initial, bar


def tokens_of_org(text: str) -> list[str]:
    t = re.sub(r"\b((?:[A-Za-z]\.){2,})", lambda m: m[1].replace(".", ""), plain(text))
    t = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", t)
    words = re.findall(r"[a-z0-9]+", t.lower().replace("'", ""))
    return [SHORT.get(w, w) for w in words if w not in LEGAL]


def _within_one(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _in_order(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


def edits(a: str, b: str) -> int:
    """Damerau distance, as far as 2; 3 stands for more."""
    if a == b:
        return 0
    if _within_one(a, b):
        return 1
    if abs(len(a) - len(b)) > 2:
        return 3
    return 2 if any(_within_one(x, y) for x in _near(a, b) for y in (b,)) else 3


def _near(a: str, b: str) -> set[str]:
    """Forms of a after one edit at the first place where it differs from b."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    out = {a[:i] + a[i + 1 :], a[:i] + b[i : i + 1] + a[i:], a[:i] + b[i : i + 1] + a[i + 1 :]}
    return out | ({a[:i] + a[i + 1] + a[i] + a[i + 2 :]} if i + 1 < len(a) else set())


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, ma = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                ma.append(ch)
                break
    if not ma:
        return 0.0
    mb = [b[j] for j in range(len(b)) if used[j]]
    m, t = len(ma), sum(x != y for x, y in zip(ma, mb)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _deletions(code: str) -> set[str]:
    return {code, *(code[:i] + code[i + 1 :] for i in range(len(code)))}


def block_keys(tokens: list[str], person: bool) -> list[str]:
    """Phonetic keys under which two spellings of one name meet: one consonant of one token may differ."""
    out: set[str] = set()
    if person:
        pairs = [(tokens[0], tokens[1]), (tokens[1], tokens[0])]
        pairs += [(long, s) for g, s in pairs for long in SHARED.get(g, ())]
        for given, surname in pairs:
            g, s = skeleton(given)[:3], skeleton(surname)
            out |= {f"P{given[:1]}{g}|{d}" for d in _deletions(s)}
            out.add(f"Q{given[:1]}|{s}|{surname[:2]}")
            out |= {f"R{d}|{s}" for d in _deletions(skeleton(given))}
    else:
        core = skeleton(tokens[0])
        out = {f"O{d}|{tokens[1]}" for d in _deletions(core)}
    return sorted(out)


_SCHEMA = "type string, text string, n long, kind string, node string, a string, b string, initial string, votes long, keys array<string>"


def _parse_forms(generic: frozenset):
    def generic_of(w: str) -> str | None:
        if w in generic:
            return w
        if len(w) < 3:
            return None
        near = [g for g in generic if abs(len(g) - len(w)) < 2 and _within_one(w, g)] if len(w) > 3 else []
        if not near and len(w) > 6:
            near = [g for g in generic if len(g) > 6 and edits(w, g) <= 2]
        if not near:  # a short form keeps the first and last letter and the order of the others
            near = [g for g in generic if g[0] == w[0] and g[-1] == w[-1] and len(w) < len(g) and _in_order(w, g)]
        return near[0] if len(near) == 1 else None

    def parse(batches):
        cached = functools.lru_cache(100_000)(generic_of)
        for pdf in batches:
            rows = []
            for typ, text, n in zip(pdf["type"], pdf["text"], pdf["n"]):
                if typ == "PERSON":
                    kind, tok, initial, sure = parse_person(text)
                    if kind == "full":
                        a, b = sorted(tok)
                        vote = (2 if sure else 1) * (n if b == tok[1] else -n)  # above 0: the second of the sorted tokens is the surname
                        rows.append((typ, text, n, kind, f"P {a} {b}", a, b, None, vote, block_keys([a, b], True)))
                    elif kind != "none":
                        rows.append((typ, text, n, kind, None, tok[0], None, initial or None, 0, None))
                else:
                    words = tokens_of_org(text)
                    gen = [cached(w) for w in words]
                    core = "".join(sorted(w for w, g in zip(words, gen) if g is None))
                    kinds = " ".join(sorted({g for g in gen if g}))
                    if not core:
                        core, kinds = "".join(sorted(words)), ""
                    if not core:
                        continue
                    full = kinds.count(" ") >= 1 or not kinds
                    rows.append((typ, text, n, "org" if full else "part", f"O {core} {kinds}" if full else None, core, kinds, None, 0, block_keys([core, kinds], False) if full else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return parse


def _alike(a: str, b: str) -> tuple[int, float]:
    if b in SHARED.get(a, ()) or a in SHARED.get(b, ()):
        return 0, 1.0
    return edits(a, b), jaro_winkler(a, b)


def _may_be_one():
    """Whether what _compare accepts is possible for a row (type, a, b, a2, b2): cheap tests first, and Levenshtein's distance,
    in which a swap of neighbours counts two, only where they leave it open."""
    near = lambda x, y, most: F.levenshtein(x, y, most) >= 0
    size = lambda x, y: F.abs(F.length(x) - F.length(y)) <= 1

    def tokens(x: str, y: str):
        """a like x and b like y within two edits: both in one token, or one in each."""
        one_each = size("a", x) & size("b", y) & near("a", x, 2) & near("b", y, 2)
        return F.when(F.col("a") == F.col(x), near("b", y, 4)).when(F.col("b") == F.col(y), near("a", x, 4)).otherwise(one_each)

    short = F.col("a").isin(*SHARED) | F.col("b").isin(*SHARED) | F.col("a2").isin(*SHARED) | F.col("b2").isin(*SHARED)
    total = F.abs(F.length("a") + F.length("b") - F.length("a2") - F.length("b2")) <= 2
    person = short | (total & (tokens("a2", "b2") | tokens("b2", "a2")))
    return F.when(F.col("type") == "PERSON", person).otherwise((F.col("b") == F.col("b2")) & near("a", "a2", 4))


_COMPARED = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("cost", T.IntegerType()), T.StructField("jw", T.DoubleType())])


@F.pandas_udf(_COMPARED)
def _compare(person: pd.Series, a1: pd.Series, b1: pd.Series, a2: pd.Series, b2: pd.Series) -> pd.DataFrame:
    """Whether two nodes may be one name: each token within one edit or the pair within two, and alike by Jaro-Winkler."""
    out = []
    for p, x1, y1, x2, y2 in zip(person, a1, b1, a2, b2):
        if not p:
            e, jw = edits(x1, x2), jaro_winkler(x1, x2)
            out.append((e <= (1 if len(x1) < 8 else 2) and y1 == y2 and jw >= 0.88, e, jw))
            continue
        best = (False, 9, 0.0)
        for u, v in ((x2, y2), (y2, x2)):
            (e1, j1), (e2, j2) = _alike(x1, u), _alike(y1, v)
            ok = e1 + e2 <= 2 and min(j1, j2) >= 0.8 and max(e1, e2) < 2 or (e1 == 0 and e2 == 2 and j2 >= 0.92 and len(y1) > 7) or (e2 == 0 and e1 == 2 and j1 >= 0.92 and len(x1) > 7)
            cand = (ok, e1 + e2, (j1 + j2) / 2)
            if (cand[0], -cand[1], cand[2]) > (best[0], -best[1], best[2]):
                best = cand
        out.append(best)
    return pd.DataFrame(out, columns=["ok", "cost", "jw"])


class NameClusters:
    """Clusters of the names in mentions and entity aliases.

    Names with null or blank text, and of other types than PERSON and ORG, are in no cluster; repeated rows count
    towards a name's frequency only. resolve() gives the tables that queries use.
    """

    def __init__(self, mentions: DataFrame, aliases: DataFrame, entities: DataFrame):
        self.keep = StageTables(mentions.sparkSession, "names")
        m = mentions.select("mention_id", "article_id", "text", F.col("label").alias("type")).where("type in ('PERSON', 'ORG') and text is not null and mention_id is not null").distinct()
        self.mentions = m
        e = entities.select("entity_id", F.col("entity_type").alias("type"), "canonical_name").where("entity_id is not null").distinct()
        al = aliases.select("entity_id", "alias").where("entity_id is not null and alias is not null").distinct()
        self.aliases = al.join(e.select("entity_id", "type"), "entity_id").select("entity_id", "type", F.col("alias").alias("text"))
        canon = e.where("canonical_name is not null").select("entity_id", "type", F.col("canonical_name").alias("text"))
        self.names_of = self.keep.write(self.aliases.unionByName(canon).where("type in ('PERSON', 'ORG')").distinct(), "names_of")
        self.resolve()

    def _forms(self) -> DataFrame:
        n = self.mentions.groupBy("type", "text").agg(F.count("*").alias("n"))
        n = n.unionByName(self.names_of.groupBy("type", "text").agg(F.count("*").alias("n")))
        n = self.texts = self.keep.write(n.groupBy("type", "text").agg(F.sum("n").alias("n")), "texts")
        # a word belongs to firms' kinds if it stands behind the first words of many firms; spellings of one first word count once
        words = self.keep.write(n.where("type = 'ORG'").mapInPandas(_org_words, "word string, first string"), "org_words")
        firsts = words.select("first").distinct().count()
        counted = words.groupBy("word").agg(F.countDistinct("first").alias("k")).where(F.col("k") >= max(MIN_FIRSTS, GENERIC_SHARE * firsts))
        generic = frozenset(SHORT.values()) | {r["word"] for r in counted.select("word").collect()}  # at most words a name / GENERIC_SHARE
        return self.keep.write(n.mapInPandas(_parse_forms(generic), _SCHEMA), "forms")

    def resolve(self) -> None:
        keep, forms = self.keep, self._forms()
        nodes = forms.where("node is not null").groupBy("node", "type", "a", "b").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"), F.first("keys").alias("keys"))
        # with how many other tokens each token goes
        tok = nodes.select("type", F.explode(F.array(F.struct(F.col("a").alias("t"), F.col("b").alias("o")), F.struct(F.col("b").alias("t"), F.col("a").alias("o")))).alias("x"))
        with_ = tok.groupBy("type", "x.t").agg(F.countDistinct("x.o").alias("k"))
        for c in ("a", "b"):
            nodes = nodes.join(with_.select("type", F.col("t").alias(c), F.col("k").alias(f"k{c}")), ["type", c])
        nodes = keep.write(nodes, "nodes")
        k = nodes.select("type", "node", "a", "b", "n", "ka", "kb", F.explode("keys").alias("key"))
        # the more frequent spelling leads; each spelling follows the one best leader
        p = pairs_within(k, "key", "node").where("n < n2 or (n = n2 and node > node2)")
        p = p.where(_may_be_one()).drop("key", "type2").distinct()
        p = p.withColumn("c", _compare(F.col("type") == "PERSON", "a", "b", "a2", "b2")).where("c.ok")
        # a spelling written nearly as often as its leader follows it only by one edit in a token that is rare beside the
        # leader's (it goes with few other tokens), or that is long and goes with nothing else
        attested = (F.col("n") > 2) & (F.col("n") * 4 > F.col("n2"))
        rare = lambda c, o: (F.col(f"k{c}") * 4 <= F.col(f"k{o}2")) | ((F.length(c) >= LONG) & (F.col(f"k{c}") == 1))
        one = lambda c, o, e, f: (F.col(c) == F.col(f"{o}2")) & rare(e, f)
        apart = one("a", "a", "b", "b") | one("a", "b", "b", "a") | one("b", "b", "a", "a") | one("b", "a", "a", "b")
        p = p.where(~attested | ((F.col("c.cost") == 1) & apart))
        w = Window.partitionBy("node").orderBy("c.cost", F.desc("c.jw"), F.desc("n2"), "node2")
        best = p.withColumn("r", F.row_number().over(w)).where("r = 1").select("node", "node2")
        # an entity's own full names are one name
        of = self.names_of.join(forms.select("type", "text", "node", "kind", "a", "b", "initial"), ["type", "text"])
        of = keep.write(of, "of")
        own = of.where("node is not null").select(F.concat(F.lit("E "), "entity_id").alias("node"), F.col("node").alias("node2"))
        cc = connected_components(best.unionByName(own), "node", "node2")
        cc = keep.write(cc.select(F.col("vertex").alias("node"), F.col("component").alias("cluster")), "cc")
        at = nodes.join(cc, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
        at = keep.write(at.select("node", "type", "a", "b", "n", "votes", "cluster"), "at")
        # what a partial name can fit: surname with initial for persons, core with kind for firms
        person = at.where("type = 'PERSON'").select(
            "cluster", "n", F.when(F.col("votes") > 0, F.col("b")).otherwise(F.col("a")).alias("name"), F.when(F.col("votes") > 0, F.col("a")).otherwise(F.col("b")).alias("given")
        )
        lead = Window.partitionBy("cluster").orderBy(F.desc("n"), "name", "given")
        person = person.withColumn("r", F.row_number().over(lead)).where("r = 1 or n >= 4")
        offers = person.select(F.lit("PERSON").alias("type"), "name", F.substring("given", 1, 1).alias("more"), "cluster").unionByName(
            at.where("type = 'ORG'").select("type", F.col("a").alias("name"), F.explode(F.split("b", " ")).alias("more"), "cluster")
        )
        offers = keep.write(offers.distinct(), "offers")
        parts = forms.where("node is null").select("type", "text", F.col("a").alias("name"), F.coalesce("initial", F.when(F.col("type") == "ORG", F.col("b"))).alias("more"))
        fits = lambda same: same & (F.col("p.more").isNull() | (F.col("p.more") == "") | (F.col("p.more") == F.col("o.more")))
        p, o = parts.alias("p"), offers.alias("o")
        exact = p.join(o, fits((F.col("p.type") == F.col("o.type")) & (F.col("p.name") == F.col("o.name")))).select("p.type", "p.text", "o.cluster").distinct()
        exact = keep.write(exact, "exact")
        rest = parts.join(exact.select("type", "text").distinct(), ["type", "text"], "left_anti")
        rest = rest.withColumn("v", F.explode(_surname_keys("name"))).alias("p")
        near = offers.withColumn("v", F.explode(_surname_keys("name"))).alias("o")
        fuzzy = rest.join(near, fits((F.col("p.type") == F.col("o.type")) & (F.col("p.v") == F.col("o.v")))).select("p.type", "p.text", F.col("p.name").alias("a"), F.col("o.name").alias("a2"), "o.cluster").distinct()
        fuzzy = fuzzy.withColumn("c", _compare(F.lit(False), "a", F.lit(""), "a2", F.lit(""))).where("c.ok and c.cost <= 1")
        w = Window.partitionBy("type", "text")
        fuzzy = fuzzy.withColumn("least", F.min("c.cost").over(w)).where("c.cost = least").select("type", "text", "cluster")
        fit = keep.write(exact.unionByName(fuzzy).distinct(), "fit")
        one = fit.groupBy("type", "text").agg(F.min("cluster").alias("cluster"), F.count("*").alias("k"))
        full = forms.where("node is not null").join(at.select("node", "cluster"), "node").select("type", "text", "cluster")
        self.sure = keep.write(full.unionByName(one.where("k = 1").select("type", "text", "cluster")), "sure")
        self.fit = fit.join(one.where("k > 1").select("type", "text"), ["type", "text"])
        # entities: by their full names, else by the one cluster their partial names fit
        of = self.names_of.join(self.sure, ["type", "text"]).groupBy("entity_id", "type").agg(F.min("cluster").alias("least"), F.countDistinct("cluster").alias("k"), F.collect_set("cluster").alias("cs"))
        byfull = self.names_of.join(full, ["type", "text"]).groupBy("entity_id").agg(F.min("cluster").alias("full"))
        ent = of.join(byfull, "entity_id", "left").select("entity_id", "type", F.coalesce("full", F.when(F.col("k") == 1, F.col("least"))).alias("cluster")).where("cluster is not null")
        self.entity_cluster = keep.write(ent, "entity_cluster")
        # mentions: by their text, else by the one fitting cluster that has a sure mention in the same article
        # one text may be a large part of all mentions
        sure = spread_join(self.mentions, self.sure, ["type", "text"], "mention_id", counts=self.texts).select("mention_id", "article_id", "type", "text", "cluster")
        self.sure_mentions = sure
        # an article's few clusters first, then the texts that fit them: a surname of very many mentions and clusters never fans out
        there = sure.select("article_id", "cluster").distinct().join(self.fit, "cluster")
        open_ = self.mentions.join(there, ["article_id", "type", "text"])
        open_ = open_.groupBy("mention_id", "text").agg(F.min("cluster").alias("cluster"), F.count("*").alias("k")).where("k = 1")
        self.mention_cluster = sure.select("mention_id", "text", "cluster").unionByName(open_.select("mention_id", "text", "cluster"))


def _org_words(batches):
    for pdf in batches:
        rows = []
        for t in pdf["text"]:
            w = tokens_of_org(t)
            rows += [(x, skeleton(w[0])) for x in set(w[1:])]
        yield pd.DataFrame(rows, columns=["word", "first"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _surname_keys(names: pd.Series) -> pd.Series:
    return names.map(lambda x: sorted(_deletions(skeleton(x))))


def linked_names(mentions: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(left_id, right_id), left_id < right_id: entity ids of one person or organisation, and mentions whose text is
    no alias character for character with each entity id of the one meant."""
    c = NameClusters(mentions, aliases, entities)
    e = c.entity_cluster.select("cluster", "entity_id")
    pairs = e.withColumnRenamed("entity_id", "left_id").join(e.withColumnRenamed("entity_id", "right_id"), "cluster").where("left_id < right_id").select("left_id", "right_id")
    known = aliases.where("alias is not null").select(F.col("alias").alias("text")).distinct()
    m = c.mention_cluster.join(known, "text", "left_anti").join(e, "cluster")
    m = m.select(F.least("mention_id", "entity_id").alias("left_id"), F.greatest("mention_id", "entity_id").alias("right_id"))
    return pairs.unionByName(m).distinct()


def _tables(spark, sf_dir):
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("mentions", "entity_aliases", "entities")]


def p1_found(spark, sf_dir):
    return linked_names(*_tables(spark, sf_dir))


def p1_clusters(spark, sf_dir):
    """Each entity's cluster, by size."""
    e = NameClusters(*_tables(spark, sf_dir)).entity_cluster
    return e.groupBy("type", "cluster").agg(F.count("*").alias("entity_ids"), F.min("entity_id").alias("first_entity_id")).drop("cluster")


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters}
SQL: dict[str, str] = {}
