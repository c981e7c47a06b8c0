"""Abbreviations that end in a period, in a trie read from the period backwards."""

from __future__ import annotations

# Fixed values. NEVER: what follows always belongs to the same sentence.
NEVER = """
e.g. i.e. cf. vs. viz. resp. incl. excl. esp. ca. a.k.a. w.r.t. w.l.o.g. i.a. 
Mr. Mrs. Ms. Dr. Prof. Rev. Hon. Gen. Col. Capt. Lt. Sgt. Gov. Sen. Rep. Pres. St. Mt. Messrs. Mx.
z.B. d.h. u.U. i.d.R. o.g. s.o. s.u. v.a. u.a. vgl. Vgl. bzw. bspw. ggf. evtl. inkl. exkl. sog. insb. mind. zzgl. zw. Hr. Fr. Hrn. Dipl. Ing. Mag. hrsg. Hrsg. gem. lt. bez. bzgl.
p.ex. c.-à-d. env. Env. M. MM. Mme. Mlle. Mgr. Cf. av. apr. 
p.ej. Sr. Sra. Srta. Sres. Dra. D. Dña. Ud. Uds. Vd. Vds. aprox. Aprox. pág. págs. núm. núms. Núm. art. 
т.е. т.к. напр. Напр. см. См. ср. Ср. ок. Ок. проф. акад. д-р. им. г-н. г-жа. и.о. тов. гр. ул. пл.
π.χ. δηλ. βλ. Βλ. πρβλ. κ. κα. κος. Δρ. δρ. καθ. αρ. σελ. δευτ. λ.χ. μ.Χ. π.Χ. βλ.
डॉ. प्रो. श्री. क्र. सं. पृ. कु. सुश्री. रु. 
د. أ. م. ص. ج. هـ. أ.د. ق.م.
ดร. น.ส. ด.ช. ด.ญ. ผศ. รศ. ศ. พ.ศ. ค.ศ. น. ม. กม. ซม. กก. ร.ศ.
"""

# Fixed values. NUMBER: a number, a lone letter or a small letter that follows belongs to it; a capitalised word begins anew.
NUMBER = """
No. Nos. no. Fig. Figs. fig. Eq. Eqs. eq. Sec. Secs. sec. Ch. ch. Chap. chap. App. Tab. Ref. Refs. Vol. vol. p. pp. P. pp. art. Art. ed. Ed. par. approx. Approx. max. min. avg. Max. Min. est. Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Sept. Oct. Nov. Dec. v. ver. rev. ln. col. dept. Dept. fl. ext.
Nr. Nrn. S. Abb. Abs. Anm. Aufl. Bd. Bde. Kap. Ziff. Tel. Str. Std. Min. Sek. Mio. Mrd. Tsd. max. min. ca. Jh. Okt. Dez. Mär. 
n. n° fig. chap. art. éd. vol. tél. janv. févr. avr. juil. sept. oct. nov. déc. réf. sect. 
fig. cap. ref. vol. tel. ene. ago. dic. sec.
стр. рис. табл. гл. п. пп. тыс. млн. млрд. руб. коп. кв. д. ч. мин. сек. т. с.
εικ. πιν. κεφ. τόμ. τ. σ. σσ. εκ. χιλ.
"""

# Fixed values. MAYBE: ends a sentence if a new one follows, as a capital letter shows.
MAYBE = """
etc. al. a.m. p.m. A.M. P.M. U.S. U.K. U.N. E.U. D.C. Ph.D. M.D. B.A. M.A. Ltd. Inc. Co. Corp. Bros. Jr. LLC. Esq. ff. f. seq.
usw. u.v.m. u.ä. o.ä. etc. GmbH. Chr. 
ecc. cie. Cie. S.A. S.L.
т.д. т.п. др. пр. н.э. в. вв. гг. 
κ.λπ. κ.ά. κ.ο.κ. κ.τ.λ. μ.μ. π.μ. Α.Ε.
"""

# Fixed values. NAME: stands before a name as a title and, after a number, for a unit that may end a sentence.
NAME = """г. M. s. м."""

CLASSES = {"never": NEVER, "number": NUMBER, "maybe": MAYBE, "name": NAME}


def _entries():
    for kind, listed in CLASSES.items():
        for word in listed.split():
            yield kind, word


#: Abbreviations of several words: every period but the last is inside.
# Fixed values.
SPACED = {
    "never": ["z. B.", "d. h.", "u. U.", "i. d. R.", "o. g.", "s. o.", "s. u.", "v. a.", "u. a.", "p. ex.", "p. ej.", "c. à d.", "т. е.", "т. к.", "и. о.", "π. χ.", "क्र. सं.", "ई. पू.", "EE. UU.", "e. g.", "i. e.", "λ. χ.", "См. рис.", "см. рис."],
    "maybe": ["т. д.", "т. п.", "н. э.", "u. v. m.", "u. ä.", "o. ä.", "n. Chr.", "v. Chr.", "a. m.", "p. m.", "κ. λπ.", "κ. ά.", "S. A.", "et al."],
}


def build() -> dict:
    """Nested dicts of characters read backwards; at "" the class. Later classes win over earlier ones."""
    trie: dict = {}

    def put(word: str, kind: str) -> None:
        at = trie
        for ch in reversed(word):
            at = at.setdefault(ch, {})
        at[""] = kind

    for kind, word in _entries():
        if word.endswith("."):
            put(word, kind)
    for kind, words in SPACED.items():
        for word in words:
            put(word, kind)
    return trie


#: Beginnings of the spaced ones, up to each inner period, and what must follow.
INNER: dict[str, set[str]] = {}
for _words in SPACED.values():
    for _w in _words:
        _parts = _w.split(" ")
        for _k in range(1, len(_parts)):
            if _parts[_k - 1].endswith("."):
                INNER.setdefault(_parts[_k - 1], set()).add(_parts[_k])

TRIE = build()


def lookup(text: str, end: int) -> tuple[str, int] | None:
    """Class and start of the longest abbreviation in ``text`` that ends with the period before ``end``, at a word's start."""
    at, i, best = TRIE, end - 1, None
    while i >= 0:
        ch = text[i]
        if ch.isspace():  # a line break, or several spaces, within an abbreviation is one
            while i > 0 and text[i - 1].isspace():
                i -= 1
            ch = " "
        at = at.get(ch)
        if at is None:
            break
        if "" in at and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in "_.-/")):
            best = at[""], i
        i -= 1
    return best
