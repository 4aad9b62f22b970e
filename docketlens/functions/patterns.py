"""The patterns and word lists that results must agree on."""

# Characters that may stand between the two halves of a phrase.
FILLER = r"[a-zA-Z0-9 ()\[\]:#,.'\"\-$]"

# Outcome groups in the order in which they are tried; the first group with a match wins.
OUTCOME_EXCLUSIONS = ["order of service"]
OUTCOME_GROUPS = {
    1: [
        rf"grant{FILLER}{{1,400}}(in forma pauperis|ifp)",
        rf"(in forma pauperis|ifp){FILLER}{{1,400}}grant[seding]{{1,3}}",
        rf"order{FILLER}{{1,10}}proceed (in forma pauperis|ifp)",
        rf"order{FILLER}{{1,10}}grant{FILLER}{{1,80}}without prepaying",
        rf"prepay{FILLER}{{1,100}}grant",
        "waive filing fee grant",
    ],
    -1: [
        rf"den[yingieds]{{1,4}}{FILLER}{{1,400}}(in forma pauperis|ifp)",
        rf"(in forma pauperis|ifp){FILLER}{{1,400}}den[iedyings]{{1,4}}",
        rf"order{FILLER}{{1,10}}den{FILLER}{{1,80}}without prepaying",
        rf"prepay{FILLER}{{1,100}}den[iedyings]{{1,4}}",
        "waive filing fee den[iedyings]{1,4}",
        "initial partial filing fee",
        "directing monthly payments be made from prison account",
    ],
    -999: [
        rf"appeal{FILLER}{{1,100}}good faith{FILLER}{{1,100}}should not{FILLER}{{1,100}}in forma pauperis",
        rf"order to consolidate cases{FILLER}{{1,500}}all future pleadings",
        rf"case was assigned incorrectly{FILLER}{{1,400}}hereby ordered{FILLER}{{1,400}}transferred",
        rf"transfer[ringed]{{0,4}}{FILLER}{{1,30}}(to|from){FILLER}{{1,30}}district",
        rf"(direct|order){FILLER}{{1,40}}fil{FILLER}{{1,400}}forma pauperis",
        rf"has not{FILLER}{{0,80}}submit{FILLER}{{1,80}}(fil|motion){FILLER}{{1,200}}forma pauperis",
        "no longer pending in this court",
    ],
    -10: [
        "order of dismissal",
        "notice of [voluntary ]{0,11}dismissal",
        rf"order dismiss{FILLER}{{0,40}}(prejudice|case)",
        rf"dismiss{FILLER}{{0,40}}case{FILLER}{{0,20}}entirety",
    ],
}
# Best outcome first.
OUTCOME_PRIORITY = [1, -1, -999, -10]

# Phrases that admit a case, that select its lines, and that tell an appeal.
BASIC_PHRASES = ["pauperis", "ifp", "without prepay", "without the pay", "without pay", "1915"]
ALL_PHRASES = [*BASIC_PHRASES, "consolidate", "transfer", "remand", "dismiss", "no longer pending", "reduced filing fee procedure"]
APPEAL_PHRASES = ["notice of appeal"]
# Kinds of entries by their leading capitals, in the order in which they are tried.
ENTRY_KINDS = ["APPLICATION", "MOTION", "REQUEST", "COMPLAINT", "AFFIDAVIT", "MINUTE ORDER", "ORDER", "DECISION", "OPINION"]
# Where a line ends a sentence, fixed values: a joint between clauses, or a stop after a word and before a capital.
SENTENCE_END = r" and | but |;|: #|, #|(?<=(?:[^\.]{4}[a-z]|[^\.]{3}[^\. ][A-Z]))\. (?=[A-Z\(][^\.]{4})"
# What a sentence says, by action: fixed values.
_FILL = r"[a-zA-Z0-9 ()\[\]:#\,\.\'\"\-\$&/]"
_FILL_STAR = r"[a-zA-Z0-9 ()\[\]:#\,\.\'\"\-\$&/\*]"
_PREPAY = "without (pre|the )?pay"
_STATUTE = "under 28 ?u\\.?s\\.?c\\.? ?\u00a7? ?1915"
_IFP = "(in ?forma ?pauperis|ifp)"
_NOT_ASKED = (
    "(?<![0-9] )(?<!re )(?<!re: )(?<!re [0-9] )(?<!re: [0-9] )(?<!the )(?<!'s )(?<!^a )(?<!^an )(?<!^no )(?<! a )(?<! an )(?<! no )"
    "(?<!grant )(?<!grants )(?<!granting )(?<!deny )(?<!denies )(?<!denying )(?<!supplemental )"
)
_TO_PROCEED = f"to proceed (in district court )?(in ?forma ?pauperis|ifp|{_PREPAY}|{_STATUTE})(?! on appeal)(?! (o|i)n (his|her) appeal)(?! on transcripts)"
_NOT_BEFORE = "(?<!appeal )(?<!case files )(?<!or an )"
_NOT_AFTER = (
    "(?! on appeal)(?! status on appeal)(?! (o|i)n (his|her) appeal)(?! status (o|i)n (his|her) appeal)(?! for the purpose of an appeal)(?! status for the purpose of an appeal)(?! on transcripts)"
)
_NOT_DENIED = "(?!as moot)(?!in part)(?!for the purpose of an appeal)"
_ASKED = f"{_NOT_BEFORE}{_IFP}{_NOT_AFTER}"
_UNPAID = f"{_NOT_BEFORE}({_PREPAY}|{_STATUTE})"
STATUS_GROUPS = {
    "application": [rf"(?:^|, )(?!order){_FILL_STAR}{{0,30}}?{_NOT_ASKED}(motion|application|request|affidavit|letter){_FILL}{{1,50}}?{_TO_PROCEED}"],
    "grant": [
        rf"grant(?!(s|ed|ing)? ((P|p)laintiff )?(thirty|30) days)(?!(s|ed|ing)? in part){_FILL}{{1,400}}?{_ASKED}",
        rf"{_ASKED}{_FILL}{{1,400}}?(?<!if such leave should be )grant(?!ed in part)",
        rf"(?<!if he is )(?<!if she is )allow{_FILL}{{1,400}}?{_ASKED}",
        rf"{_ASKED}{_FILL}{{1,400}}?allow",
        rf"grant(?!(s|ed|ing)? in part){_FILL}{{1,80}}?{_UNPAID}",
        rf"{_UNPAID}{_FILL}{{1,100}}?grant(?!ed in part)",
        rf"may proceed{_FILL}{{1,30}}(in ?forma ?pauperis|ifp|{_PREPAY})",
        "waive filing fee grant",
    ],
    "deny": [
        rf"den(y |ies |ied |ying ){_NOT_DENIED}{_FILL}{{0,400}}?{_ASKED}",
        rf"{_ASKED}{_FILL}{{1,400}}?(?!appeal is )den(y |ies |ied(\.| )|ying ){_NOT_DENIED}",
        rf"(?!appeal is )den(y |ies |ied |ying ){_NOT_DENIED}{_FILL}{{0,100}}?{_UNPAID}",
        rf"{_UNPAID}{_FILL}{{1,100}}?(?!appeal is )den(y |ies |ied(\.| )|ying ){_NOT_DENIED}",
        rf"order{_FILL}{{1,60}}?den{_FILL}{{1,80}}?{_NOT_BEFORE}{_PREPAY}",
        rf"waive filing fee den(y |ies |ied(\.| )|ying ){_NOT_DENIED}",
        "ordered to pay (the)? full",
    ],
    "other": [
        rf"{_IFP}{_FILL}{{1,400}}?moot",
        rf"(find|stricken|terminat|den)[iedyings]{{0,4}} as moot{_FILL}{{1,400}}?forma ?pauperis",
        "grant(s|ed|ing)? in part",
        rf"order to consolidate cases{_FILL}{{1,500}}?all future pleadings",
        rf"case was assigned incorrectly{_FILL}{{1,400}}?hereby ordered{_FILL}{{1,400}}?transferred",
        rf"(transfer[redings]{{0,4}}|remand[edings]{{0,3}}){_FILL}{{1,30}}?to{_FILL}{{1,30}}?(district|division)",
        "no longer pending in this court",
        "notice of [voluntary ]{0,11}dismissal",
        rf"dismiss{_FILL}{{0,40}}?case{_FILL}{{0,20}}?(entirety|frivolous)",
        rf"appeal{_FILL}{{1,100}}?good faith{_FILL}{{1,100}}?should not{_FILL}{{1,100}}?in ?forma ?pauperis",
        rf"(direct|order)(?! grant)(?! den){_FILL}{{1,40}}?fil{_FILL}{{1,400}}?forma ?pauperis",
        rf"has not{_FILL}{{0,80}}?submit{_FILL}{{1,80}}?(fil|motion){_FILL}{{1,200}}?forma ?pauperis",
        "reduced (payment|filing fee) procedure",
    ],
}
# For each status pattern words of which any match holds at least one, in the patterns' order.
_STATUS_WORDS = {
    "application": [["to proceed "]],
    "grant": [["grant"], ["grant"], ["allow"], ["allow"], ["grant"], ["grant"], ["may proceed"], ["waive filing fee grant"]],
    "deny": [["den"], ["den"], ["den"], ["den"], ["den"], ["waive filing fee den"], ["ordered to pay "]],
    "other": [
        ["moot"], ["as moot"], [" in part"], ["order to consolidate cases"], ["case was assigned incorrectly"], ["transfer", "remand"], ["no longer pending in this court"], ["dismissal"], ["dismiss"],
        ["good faith"], ["pauperis"], ["has not"], ["reduced "],
    ],
}
STATUS_WORDS = {pattern: words for action, group in STATUS_GROUPS.items() for pattern, words in zip(group, _STATUS_WORDS[action], strict=True)}
# How a line that opens an appeal begins, and how later lines name its number.
APPEAL_OPENINGS = APPEAL_PHRASES
APPEAL_NUMBERS = [r"(\d+)[.)\]]? ?notice ?of ?appeal", r"notice ?of ?appeal ?[(\[]? ?(?:no ?\.?|#)? ?(\d+)[.)\] ]", r"(?:dkt|docket) ?(?:no ?\.?|#)? ?(\d+)[.)\] ]"]

# Fixed values of the sealing indicators: fragments, then a pattern for each flag.
ARTICLE = r"(motion|order|document|reply|response|affidavit|attachment|transcript|declaration|image|exhibit|indictment|judgement|vesrion)s?"
DOCKET_NO = r"\(?\d{1,4}\)?"
SEAL = r"(seal|file (\w+ )?under seal)"
UNSEAL = r"(?<!\(case )unseal"
MOTION = r"motion( for leave)?"
INDICATORS = {
    "seal_motion": rf"({MOTION}|order) (by (\S+ ){{1,15}})?(to {SEAL}|sealing)",
    "unseal_motion": rf"(unsealing)|(({MOTION}|order) (by (\S+ ){{1,15}})?(to unseal|unsealing))",
    "seal_grant": rf"granting ({DOCKET_NO} )?{MOTION} to {SEAL}",
    "seal_grant_p": rf"granting in part ({DOCKET_NO} )?{MOTION} to {SEAL}",
    "seal_deny": rf"denying (as moot |without prejudice )?({DOCKET_NO} )?{MOTION} to {SEAL}",
    "seal_deny_p": rf"denying in part ({DOCKET_NO} )?{MOTION} to {SEAL}",
    "unseal_grant": rf"granting ({DOCKET_NO} )?{MOTION} to unseal",
    "unseal_grant_p": rf"granting in part ({DOCKET_NO} )?{MOTION} to unseal",
    "unseal_deny": rf"denying (as moot |without prejudice )?({DOCKET_NO} )?{MOTION} to unseal",
    "unseal_deny_p": rf"denying in part ({DOCKET_NO} )?{MOTION} to unseal",
    "part_grant_deny": r"((granted|granting),? in part and (denied|denying) in part|granting\s?/\s?denying in part)",
    "parenthesis": rf"\(sealed( {ARTICLE})?\)",
    "case_unsealed": "case unsealed",
    "system_entry": "^system entry",
    "sealed_article": rf"(?<!if there are )sealed {ARTICLE}",
    "e_gov": "e-government",
    "redacted": rf"^redaction|(un)?redacted {ARTICLE}",
    "protective": r"^(agreed |joint |notice of motion.{1,55})?(motion for )?protective order",
    "restricted": rf"^(\*)?restrict|restricted {ARTICLE}|{ARTICLE} restricted|\(restricted\)",
    "discovery_control": r"((stipulated|stipulation for)|(agreed|joint|unopposed)( sealed)? motion .{1,100}) (protective order|discovery control|docket control order)",
}

# Labels from the most to the least specific, for relabelling after an update.
LABEL_RANK = ["FJC Judge", "BA-MAG Judge", "District_Judge", "Magistrate_Judge", "Bankruptcy_Judge", "Circuit_Appeals", "Nondescript_Judge", "Judicial_Actor"]
# Nature-of-suit codes of prisoner cases.
PRISONER_NOS = [510, 530, 535, 540, 550, 555, 560]
# Letters without their accents, as pairs.
ACCENTS = ("áàéêéíóöúüñ", "aaeeeioouun")
# Steps of the name cleaner, in order: what goes (any case where marked), and what stands there instead.
NAME_STEPS = [
    (r"(?i)(mag\. judge|judge|magjud|- ?MagJud|magistrate)", ""),
    (r"(?i)(\\xc2|\\xa71)", ""),
    (r"(?i)(\\xc3|\\xa1)", "a"),
    (r"(?i)'s($|\s+(?!(jr|sr)\.*))|' s$", " "),
    (r"[0-9]", ""),
    (r"(!|\"|#|%|&|\*|\+|,|/|=|\?|@|\^|_|`|~|\$|\||\\)", " "),
    (r"[.](?=[^\s])", " "),
    (r"[.](?=[\s])", ""),
    (r"['](?=[\s])|(?<=[\s])[']", ""),
    (r"(?<=[^\s]) [-](?=[^\s])|(?<=[^\s])[-] (?=[^\s])", "-"),
    (r"[-]", " "),
    (r"[']", ""),
    (r"(?<=[a-zA-Z])[\[](?=[a-zA-Z]+)", ""),
    (r"(?<=[a-zA-Z])[\]](?=[\s]+)", ""),
    (r"[.]", ""),
    (r"(?i) (sr|snr|senior)", " sr"),
    (r"(?i) (jr|jnr|junior)", " jr"),
]
# The same for names of known judges as they are published.
TRUTH_STEPS = [
    (r"(?i)('s[\s\x08$]|\\'s[\s\x08$])", " "),
    (r"(?i)(\\xc2|\\xa71)", ""),
    (r"(?i)(\\xc3|\\xa1)", "a"),
    (r"\\'", "'"),
    (r"[0-9]", ""),
    (r"(!|\"|#|%|&|\*|\+|,|/|=|\?|@|\^|_|`|~|\$|\||\\)", " "),
    (r"[.](?=[^\s])", " "),
    (r"[.](?=[\s])", ""),
    (r"['](?=[\s])|(?<=[\s])[']", ""),
    (r"(-$|^-|'$|^')", ""),
    (r"(?<=[^\s]) [-](?=[^\s])|(?<=[^\s])[-] (?=[^\s])", "-"),
    (r"((?<=[a-zA-Z])|^)[\[](?=[a-zA-Z]+)", ""),
    (r"(?<=[a-zA-Z])[\]](?=[\s]+)", ""),
    (r"[.]", ""),
    (r"[']", ""),
]
# Words of institutions that are no federal trial court.
TOSS_COURTS = ["county", "tax", "municipal", "city", "appeals", "circuit", "compensation", "superior"]
# Words that admit a line, characters in which they and the flags are looked for, and characters of a line that are kept.
WIDE_NET = ["seal", "restrict", "redact", "protective"]
READ, KEPT = 200, 400
# Districts with local patent rules.
PLR_DISTRICTS = "cand casd flnd gand idd ilnd innd insd mdd mad moed nvd nhd njd nyed nynd nysd nced ncwd ohnd ohsd pawd tnwd txed txnd txsd utd waed wawd".split()
# Suffixes that are no name of their own, and titles that stand inside a name.
SUFFIXES = ["i", "ii", "iii", "iv", "v", "jr", "jnr", "snr", "sr", "senior", "junior"]
TITLE_INSIDE = r"(?i)[a-zA-Z]+[\s\x08][a-zA-Z]*\.*( ?- ?Mag\. Judge| ?- ?MagJud| Judge| Hon\.| \(magistrate\))[\s\x08][a-zA-Z]+"
# Words before a surname that may be a split-off part of it, or stand for "judge".
SPLIT_PREFIXES = ["jude", "j", "o", "mc", "van"]
