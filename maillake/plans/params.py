"""Fixed parameters of the registered driver queries.

They are shared by the Spark plans (``maillake.plans.catalog``) and their
SQL twins (``maillake.plans.oracle``) so both sides ask the same question.
"""

# Report "as of" instant: the driver's mail ends on 2001-08-01.
ASOF = "2001-08-02 00:00:00"
DAYS = 365

# "Me" address patterns (F1): LIKE any of ME and LIKE none of NOT_ME.
ME = ["customer.00000001%", "customer.00000002%", "supplier.0000000%", "customer.0000010%"]
NOT_ME = ["customer.000000015%", "supplier.000000009%"]

TOP_N = 10
TOP_FLOWS_N = 30
LISTING_N = 100

# Discovery (F3/F4) over documents: search words and the privileged pattern
# (case-sensitive, searched in the To/From/Cc stand-ins lang/source).
SEARCH_RE = "(licensed|license|released under)"
PRIVILEGED_RE = "(src1|src7)"

# Form requests (P11) and replies.
FORM_KEEP = ["name", "email", "segment"]
REPLY_TEMPLATE = ("Dear %name%,\nwe received your request from %email% (segment %segment%).\n"
                  "Reply to %from_address%, copy to %cc_address%.\n")
RESPONDER_ADDRESS = "responder@mail.example.org"
CC_ADDRESS = "archive@mail.example.org"

# Mail merge (P19-P22) and send schedule.
MERGE_TEMPLATE = ("To: %to%\nFrom: %from%\nSubject: Your account\n\n"
                  "Hello %firstname%! Your segment is %segment%, %firstname%.\n")
MERGE_DEFAULTS = {"from": "accounts@mail.example.org"}
SEND_START = "2001-09-01 08:00:00"
SEND_DELAY_SECONDS = 45

# Live mail: files, and the times at which mail or events had arrived by the first look.
MAILBOX_FILES = 8
ARRIVED = "1998-01-01 00:00:00"
FIRST_EVENTS = "2024-01-12 00:00:00"

# Suspicious mail (R14): listed domains cover their subdomains; words in lower case.
SUSPICIOUS_DOMAINS = ["tionsh.example.net", "thther.example.org", "example.com", "le.com"]
SUSPICIOUS_WORDS = ["script", "nicht aulich"]

# Tally of request mail (K9) and publications of the digest (R17), keywords in lower case.
TALLY_DATE = "2001-08-02"
PUBLICATIONS = {"nicht aulich": "Aulich Post", "thheouble": "The Ouble"}
