"""One spelling for several of a given name, and nicknames."""

from __future__ import annotations

# spelling: its variants (a spelling that is its own stands among them)
_SPELLINGS = {
    "allen": "allan allen", "bryan": "bryan brian", "catherine": "catherine catharine katherine katharine", "deborah": "deborah debora debra", "elizabeth": "elisabeth elizabeth", "erik": "erick erik eric",
    "frederick": "frederic frederick", "harold": "harold", "herold": "herold", "jacqueline": "jacquelyn jacqueline", "janice": "janis janice", "johnathan": "johnathan jonathan jonothan", "kristen": "kristin kristen",
    "lawrence": "lawrence laurence", "lewis": "lewis louis", "marsha": "marcia marsha", "megan": "megan meagan meghan", "michelle": "michelle michele", "michael": "michael mikel", "nathaniel": "nathaniel nathaneal nathanel",
    "netburn": "netburn netbum", "nicholas": "nickolas nicholas nicolas", "patrick": "patrick patric", "randall": "randal randall", "richard": "ricard", "sam": "samuel sam", "sally": "sally sallie", "sonja": "sonia sonja",
    "stephen": "stepben stephem stephen stephan", "stuart": "stewart stuart", "sylvia": "sylvia silvia", "susan": "susan suzanne", "theodore": "theodore theadore", "theresa": "teresa theresea", "therese": "thrse", "william": "wm",
}
UNIFIED = {variant: name for name, variants in _SPELLINGS.items() for variant in variants.split()}

# nicknames: the names that have them
_NICKNAMES = {
    "alex": "alexandra alexander", "raag": "anuraag", "elizabeth": "beth", "bill": "billy", "cathy casey": "catherine catharine", "chris": "christian christopher", "dave": "david", "dan": "daniel", "deb": "deborah debora debra",
    "ed": "edward", "beth": "elizabeth", "fred": "frederic frederick", "gabe": "gabriel", "greg": "gregory", "jake": "jacob", "jack": "jackson", "joe j": "joseph", "john": "johnathan jonathan jonothan", "judy": "judith",
    "kathy": "katherine katharine", "lee": "leroy", "maggie": "margaret", "marty": "martin", "matt": "matthew", "mike": "michael", "meg": "megan", "nathan nate": "nathaniel nathaneal nathanel", "nick": "nickolas nicholas nicolas",
    "pam": "pamela", "patti": "patricia", "pat": "patrick", "rich": "richard", "rudy": "rodolfo", "sam": "sam samuel samantha samson", "sim": "simeon", "sol": "solomon", "steve": "stephen steven stephan", "ted": "theodore theadore",
    "tom": "thomas", "tim": "timothy", "will wm chip": "william",
}
NICKNAMES = {name: nicks.split() for nicks, names in _NICKNAMES.items() for name in names.split()}
