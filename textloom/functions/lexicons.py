"""Word lists that results depend on; every function that uses one takes another as a parameter."""

# Words left out of content-word counts of queries.
QUERY_STOPWORDS = """
a an and are as at be been but by can do does for from had has have he her his
i if in into is it its me my no not of on or our she so some such than that the
their them then there these they this to too was we were what when where which
who will with would you your
""".split()

# Words left out of the tables of frequent words.
COMMON_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can can't could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't
has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm
i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other
ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's
the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too
under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while
who who's whom why why's will with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
text directly indirectly
""".split()

# Words that say nothing about a passage's subject.
TOPIC_STOPWORDS = """
a an the this that these those it its it's they them their there here
i you he she we us me my your his her our
is are was were be been being am do does did done doing have has had
will would shall should can could may might must
of in on at to from by for with without into onto out up down over under
about after before during between through against within across along
and or but nor so yet if then than as because while when where why how
not no none nor only just very much more most less least such same other
another both each either neither all any some many few several one two
what which who whom whose whether
""".split()

# Words for the form of a passage.
FORM_WORDS = """
text passage writing line lines sentence sentences clause clauses phrase
phrases word words paragraph section quote quotation quoted quoting
attribution tag aside asides digression parenthesis parenthetical
claim claims statement statements point remark note observation
qualification hedge concession reversal exception contrast comparative
comparison announcement explanation resumption restatement escalation
enumeration list listing question answer imperative address reader
opens opening open begins beginning begin starts start ends ending end
turns turn shifts shift moves move returns return resumes resume
repeats repeat repeated repetition follows following followed
first second third last final finally next again still
general specific broad narrow long short brief abrupt plain odd peculiar
unusual strange sudden slow flat run running
""".split()

# The three lexicons whose presence is contrasted between hard and easy queries.
LEXICONS = {
    "formal": "formal academic dense technical objective cautious scientific encyclopedic journalistic factual analytical expository scholarly clinical authoritative matter-of-fact neutral didactic".split(),
    "tone": "tone register style diction mood objective analytical cautious".split(),
    "style": "formal informal colloquial conversational casual academic literary journalistic technical poetic persuasive descriptive rhetorical promotional narrative expository objective subjective analytical critical reflective humorous sarcastic ironic satirical playful serious dramatic emotional passionate enthusiastic optimistic pessimistic".split(),
}

# Endings of query ids by which failures are counted.
ID_SUFFIXES = ("_prompt1", "_prompt2", "_m", "_prompt3", "_prompta", "_prompt4", "_prompt5", "_prompt6", "_prompt7", "_prompt8")
