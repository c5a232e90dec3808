"""SQL for DuckDB that gives the same rows as the queries of the same name."""

from __future__ import annotations

from checks import fixture as fx


class fv:  # noqa: N801
    """Fixed values that the SQL expects, written out apart from those of the operators."""

    CATEGORY_MARKS = (('Image/Media', ('v.redd.it', 'i.redd.it', 'imgur', 'giphy', 'gfycat')),
     ('Video', ('youtube', 'youtu.be', 'tiktok', 'twitch', 'vimeo')),
     ('Social Media', ('twitter', 'x.com', 'instagram', 'facebook', 'linkedin')))
    CATEGORY_OTHER = 'External Link / News'
    CATEGORY_SELF = 'Original Discussion'
    DEFAULT_SUBREDDIT = 'unknown'
    MAX_TOKENS = 7000
    MEDIA_MARKS = (('Image', ('.jpg', '.png', '.gif', 'i.redd.it', 'imgur.com')),
     ('Video', ('youtube', 'youtu.be', 'v.redd.it', 'twitch', 'tiktok')))
    MEDIA_OTHER = 'Link/Article'
    MEDIA_TEXT = 'Text/Discussion'
    MEDIA_TEXT_MARKS = ('reddit.com', 'comments')
    PUNCTUATION = '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~'
    QUESTIONS_WHEN_EMPTY = ('Summarize the main themes', 'What is the sentiment trend?', 'Identify key opinion leaders')
    QUESTIONS_WHEN_FAILED = ('Analyze the sentiment', 'Who are the top authors?', 'Summarize the controversy')
    SELF_MARKS = ('reddit.com',)
    SELF_PREFIX = 'self.'
    SENTIMENT_DISPLAY = {'negative': '🔴 Negative', 'neutral': '⚪ Neutral', 'positive': '🟢 Positive'}
    SENTIMENT_LABELS = ('positive', 'negative', 'neutral')
    WEEKDAYS = ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday')


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(x) -> str:
        if x is None or isinstance(x, str):
            return text(x)
        if isinstance(x, float):
            return f"{x!r}e0"
        return str(x).lower() if isinstance(x, bool) else str(x)

    return ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)


def contains_any(column: str, marks) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(m)})" for m in marks) + ")"


def contains_all(column: str, marks) -> str:
    return "(" + " AND ".join(f"contains({column}, {text(m)})" for m in marks) + ")"


WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

POSTS = f"""
media(m, url, domain) AS (VALUES {values(fx.MEDIA)}),
posts AS (
  SELECT e.event_id AS post_id,
         e.ts + to_days(CAST(e.event_id * 37 % 400 AS INTEGER)) AS created,
         CAST(e.user_id AS VARCHAR) AS author,
         d.source AS subreddit,
         substr(replace(d.text, chr(10), ' '), 1, 80) AS title,
         d.text AS selftext,
         d.lang AS lang,
         CAST(floor(e.value) AS BIGINT) - 20 AS score,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS comments,
         0.5e0 + CAST(CAST(json_extract_string(e.props, '$.k') AS BIGINT) % 51 AS DOUBLE) / 100
           AS upvote_ratio,
         m.url AS url, m.domain AS domain
  FROM events e
  JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
  JOIN media m ON m.m = e.event_id % 12
)"""

MATCHED = f"""
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {fx.QUERY_POST}),
matched AS (
  SELECT p.*, list_dot_product(e.embedding::DOUBLE[], (SELECT v FROM q)) AS similarity_score
  FROM posts p JOIN embeddings e ON e.vec_id = p.post_id
)"""

LEXICON = f"lexicon(word, valence) AS (VALUES {values(fx.LEXICON)})"

PUNCT = text(fv.PUNCTUATION)
CAPS = "(token = upper(token) AND token <> lower(token))"


def _step(number: int, damping: float) -> str:
    """One of the three words before a hit: degree word, then negation."""
    before, value = f"b{number}", f"v{number - 1}"
    counts = f"({before} IS NOT NULL AND lower({before}) NOT IN (SELECT word FROM lexicon))"
    loud = (
        f"CASE WHEN coalesce(m.boost, 0) <> 0 AND mixed_case AND {before} = upper({before}) AND "
        f"{before} <> lower({before}) THEN CASE WHEN {value} > 0 THEN 0.733e0 ELSE -0.733e0 END ELSE 0e0 END"
    )
    moved = (
        f"({value} + (coalesce(m.boost, 0e0) * CASE WHEN {value} < 0 THEN -1e0 ELSE 1e0 END + {loud}) * {damping}e0)"
    )
    special = {
        1: "",
        2: "WHEN lower(b2) = 'never' AND lower(b1) IN ('so', 'this') THEN 1.25e0 "
        "WHEN lower(b2) = 'without' AND lower(b1) = 'doubt' THEN 1e0",
        3: "WHEN lower(b3) = 'never' AND lower(b2) IN ('so', 'this') OR lower(b1) IN ('so', 'this') THEN 1.25e0 "
        "WHEN lower(b3) = 'without' AND (lower(b2) = 'doubt' OR lower(b1) = 'doubt') THEN 1e0",
    }[number]
    negated = f"coalesce(m.negates, false) OR contains(lower({before}), 'n''t')"
    return f"""
step{number} AS (
  SELECT s.*, CASE WHEN {counts} THEN {moved} * CASE {special} WHEN {negated} THEN -0.74e0 ELSE 1e0 END
    ELSE {value} END AS v{number}
  FROM step{number - 1} s LEFT JOIN modifiers m ON m.word = lower({before})
)"""


SENTIMENT = f"""
{LEXICON},
all_modifiers(word, boost, negates) AS (VALUES {values(fx.MODIFIERS)}),
modifiers AS (SELECT * FROM all_modifiers WHERE word NOT IN (SELECT word FROM lexicon)),
texts AS (
  SELECT post_id, trim(coalesce(title, '') || ' ' || coalesce(selftext, '')) AS t FROM posts
),
raw_tokens AS (
  SELECT post_id, unnest(string_split_regex(t, '\\s+')) AS raw,
         generate_subscripts(string_split_regex(t, '\\s+'), 1) AS i
  FROM texts
),
tokens AS (
  SELECT post_id, i,
         CASE WHEN length(trim(raw, {PUNCT})) <= 2 THEN raw ELSE trim(raw, {PUNCT}) END AS token
  FROM raw_tokens
),
post_facts AS (
  SELECT t.post_id,
         bool_or({CAPS}) AND bool_or(NOT {CAPS}) AS mixed_case,
         min(CASE WHEN lower(token) = 'but' THEN i END) AS but_at
  FROM tokens t GROUP BY t.post_id
),
emphases AS (
  SELECT post_id,
         least(length(t) - length(replace(t, '!', '')), 4) * 0.292e0
         + CASE WHEN length(t) - length(replace(t, '?', '')) > 3 THEN 0.96e0
                WHEN length(t) - length(replace(t, '?', '')) > 1
                THEN (length(t) - length(replace(t, '?', ''))) * 0.18e0 ELSE 0e0 END AS emphasis
  FROM texts
),
context AS (
  SELECT post_id, i, token, lag(token, 1) OVER w AS b1, lag(token, 2) OVER w AS b2,
         lag(token, 3) OVER w AS b3, lead(token) OVER w AS after
  FROM tokens WINDOW w AS (PARTITION BY post_id ORDER BY i)
),
valued AS (
  SELECT c.*, f.mixed_case, f.but_at, CASE
      WHEN coalesce(lower(b1) = 'no', false) OR coalesce(lower(b2) = 'no', false)
        OR coalesce(lower(b3) = 'no' AND lower(b1) IN ('or', 'nor'), false) THEN l.valence * -0.74e0
      WHEN lower(c.token) = 'no' AND lower(after) IN (SELECT word FROM lexicon) THEN 0e0
      ELSE l.valence END AS valence
  FROM context c JOIN lexicon l ON l.word = lower(c.token) JOIN post_facts f USING (post_id)
  WHERE lower(c.token) NOT IN (SELECT word FROM all_modifiers WHERE boost <> 0)
),
step0 AS (
  SELECT *, valence + CASE WHEN mixed_case AND {CAPS}
    THEN CASE WHEN valence > 0 THEN 0.733e0 ELSE -0.733e0 END ELSE 0e0 END AS v0
  FROM valued
),
{_step(1, 1.0)},
{_step(2, 0.95)},
{_step(3, 0.9)},
sums AS (
  SELECT post_id, sum(v3 * CASE WHEN but_at IS NULL OR i = but_at THEN 1e0
                                WHEN i < but_at THEN 0.5e0 ELSE 1.5e0 END) AS total
  FROM step3 GROUP BY post_id
),
pushed AS (
  SELECT post_id, total + emphasis * sign(total) AS s FROM sums JOIN emphases USING (post_id)
),
sentiment AS (
  SELECT p.post_id, coalesce(round(s / sqrt(s * s + 15), 4), 0e0) + 0e0 AS compound
  FROM posts p LEFT JOIN pushed USING (post_id)
),
scored AS (
  SELECT p.*, compound,
         CASE WHEN compound > 0.05 THEN 'positive' WHEN compound < -0.05 THEN 'negative'
              ELSE 'neutral' END AS sent_label
  FROM posts p JOIN sentiment USING (post_id)
)"""

LABELLED = """
labelled AS (
  SELECT s.*, e.label AS cluster_id, 'Cluster ' || e.label AS cluster_label
  FROM scored s JOIN embeddings e ON e.vec_id = s.post_id
)"""

DAILY = "daily AS (SELECT CAST(created AS DATE) AS day, count(*) AS n FROM posts GROUP BY 1)"

_short = rf"(^|{NOT_WORD}){WORD}{{1,2}}({NOT_WORD}|$)"
CLEANED = rf"""
cleaned AS (
  SELECT post_id,
    regexp_replace(
      regexp_replace(
        regexp_replace(
          regexp_replace(lower(coalesce(title, '')), '\p{{Nd}}+', '', 'g'),
          '{_short}', '\1\2', 'g'),
        '{_short}', '\1\2', 'g'),
      'http[^\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', '', 'g') AS cleaned
  FROM posts
)"""

TERMS = rf"""
{CLEANED},
words AS (
  SELECT post_id, unnest(regexp_extract_all(cleaned, '{WORD}{{2,}}')) AS w,
         generate_subscripts(regexp_extract_all(cleaned, '{WORD}{{2,}}'), 1) AS i
  FROM cleaned
),
kept_words AS (
  SELECT post_id, w, i, lead(w) OVER (PARTITION BY post_id ORDER BY i) AS following
  FROM words WHERE w NOT IN ({", ".join(text(w) for w in fx.STOP_WORDS)})
),
terms AS (
  SELECT post_id, w AS term, 0 AS kind, i FROM kept_words
  UNION ALL
  SELECT post_id, w || ' ' || following, 1, i FROM kept_words WHERE following IS NOT NULL
),
vocabulary AS (
  SELECT term, count(DISTINCT post_id) AS df, count(*) AS tf FROM terms GROUP BY term
  HAVING count(DISTINCT post_id) >= 3
     AND count(DISTINCT post_id) <= 0.9e0 * (SELECT count(*) FROM posts)
  ORDER BY tf DESC, term LIMIT 1000
),
raw_weights AS (
  SELECT t.post_id, t.term, count(*) AS tf,
         count(*) * (ln((1 + (SELECT count(*) FROM posts)) / (1e0 + v.df)) + 1) AS raw
  FROM terms t JOIN vocabulary v USING (term) GROUP BY t.post_id, t.term, v.df
),
weights AS (
  SELECT post_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY post_id)) AS tfidf
  FROM raw_weights
)"""

SCORE_STATS = """
stats AS (
  SELECT avg(score) AS avg_score, max(score) AS max_score, min(score) AS min_score,
         CAST(quantile_cont(score, 0.5) AS DOUBLE) AS median_score,
         CAST(quantile_cont(score, 0.9) AS DOUBLE) AS p90_score, stddev_samp(score) AS score_std
  FROM {source}
)"""

FACTS = """
{daily}, {stats},
facts AS (
  SELECT (SELECT count(*) FROM {source}) AS total,
         (SELECT CAST(min(created) AS DATE) FROM {source}) AS start_date,
         (SELECT CAST(max(created) AS DATE) FROM {source}) AS end_date,
         avg_score, max_score, min_score, median_score, p90_score, score_std,
         (SELECT day FROM daily ORDER BY n DESC, day LIMIT 1) AS peak_date,
         (SELECT n FROM daily ORDER BY n DESC, day LIMIT 1) AS peak_posts,
         (SELECT day FROM daily ORDER BY n, day LIMIT 1) AS trough_date,
         (SELECT n FROM daily ORDER BY n, day LIMIT 1) AS trough_posts,
         (SELECT string_agg(subreddit, '{separator}' ORDER BY n DESC, subreddit) FROM (
            SELECT subreddit, count(*) AS n FROM {source} WHERE subreddit IS NOT NULL
            GROUP BY 1 ORDER BY n DESC, subreddit LIMIT 3)) AS top_subreddits
  FROM stats
)"""


def facts(source: str, separator: str) -> str:
    return FACTS.format(
        source=source,
        separator=separator,
        daily=DAILY.replace("FROM posts", f"FROM {source}"),
        stats=SCORE_STATS.format(source=source),
    )


def suggestions(separator_titles: str, separator_subs: str) -> str:
    return f"""
suggestion AS (
  SELECT (SELECT string_agg(title, '{separator_titles}' ORDER BY similarity_score DESC, post_id)
          FROM (SELECT * FROM matched ORDER BY similarity_score DESC, post_id LIMIT 8)) AS titles,
         (SELECT string_agg(subreddit, '{separator_subs}' ORDER BY best) FROM (
            SELECT subreddit, min(place) AS best FROM (
              SELECT subreddit,
                     row_number() OVER (ORDER BY similarity_score DESC, post_id) AS place
              FROM matched) GROUP BY subreddit ORDER BY best LIMIT 5)) AS subreddits
)"""


def chat(column: str, row: str) -> str:
    return f"""
ranked AS (
  SELECT m.*, s.sent_label FROM matched m JOIN scored s USING (post_id)
),
chat AS (
  SELECT (SELECT count(*) FROM ranked) AS total,
         (SELECT title FROM ranked ORDER BY score DESC, similarity_score DESC, post_id LIMIT 1)
           AS viral_title,
         (SELECT score FROM ranked ORDER BY score DESC, similarity_score DESC, post_id LIMIT 1)
           AS viral_score,
         (SELECT subreddit FROM ranked GROUP BY 1 ORDER BY count(*) DESC, subreddit LIMIT 1)
           AS top_subreddit,
         (SELECT string_agg({row}, {column} ORDER BY similarity_score DESC, post_id)
          FROM (SELECT * FROM ranked ORDER BY similarity_score DESC, post_id LIMIT 15))
           AS first_rows
)"""


EDGES = """
best_authors AS (
  SELECT author, count(*) AS n FROM posts WHERE author IS NOT NULL
  GROUP BY author ORDER BY n DESC, author LIMIT 50
),
edges AS (
  SELECT author, subreddit, count(*) AS n FROM posts
  WHERE author IN (SELECT author FROM best_authors) AND subreddit IS NOT NULL
  GROUP BY author, subreddit
)"""

_domain = "coalesce(lower(trim(domain, ' ' || chr(9) || chr(10) || chr(13))), '')"
CATEGORY = (
    f"CASE WHEN starts_with({_domain}, {text(fv.SELF_PREFIX)}) OR "
    f"{contains_any(_domain, fv.SELF_MARKS)} THEN {text(fv.CATEGORY_SELF)} "
    + " ".join(
        f"WHEN {contains_any(_domain, marks)} THEN {text(label)}"
        for label, marks in fv.CATEGORY_MARKS
    )
    + f" ELSE {text(fv.CATEGORY_OTHER)} END"
)
_url = "coalesce(lower(url), '')"
MEDIA_TYPE = (
    "CASE "
    + " ".join(
        f"WHEN {contains_any(_url, marks)} THEN {text(label)}" for label, marks in fv.MEDIA_MARKS
    )
    + f" WHEN {contains_all(_url, fv.MEDIA_TEXT_MARKS)} THEN {text(fv.MEDIA_TEXT)}"
    + f" ELSE {text(fv.MEDIA_OTHER)} END"
)

BAD_TIME = "post_id % 7 = 3 OR post_id % 11 = 5"
# Texts of the fixture have no white space at their ends; the query adds some, or has only that.
PREPARED = """
whole AS (
  SELECT post_id, CASE WHEN post_id % 50 = 8 THEN '[NO_CONTENT]' ELSE translate(selftext, chr(10) || chr(9), '  ') END AS t
  FROM posts
),
prepared AS (SELECT post_id, t AS text, CAST(len(string_split_regex(t, '\\s+')) AS INTEGER) AS n_tokens FROM whole)"""

FIXED_EMPTY = "[" + ", ".join(text(x) for x in fv.QUESTIONS_WHEN_EMPTY) + "]"
FIXED_FAILED = "[" + ", ".join(text(x) for x in fv.QUESTIONS_WHEN_FAILED) + "]"
IN_RANGE = f"created >= TIMESTAMP '{fx.START}' AND created < TIMESTAMP '{fx.END}' + INTERVAL 1 DAY"


def sql(*ctes: str, select: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join((POSTS, *ctes)) + "\n" + select


SHARED_ITEMS = (
    f"keywords(keyword) AS (VALUES {values([(k,) for k in fx.KEYWORDS])})",
    # the links and hashtags that the query writes into some texts, as they have to come out
    """
added(m, kind, item) AS (VALUES
  (1, 'url', 'https://a.example/c'), (1, 'hashtag', '#tag'),
  (2, 'url', 'https://a.example/c'), (2, 'url', 'https://w.example/x_(y)'),
  (3, 'url', 'https://a.example/c#frag'), (3, 'hashtag', '#äö_1')
)""",
    """
items AS (
  SELECT post_id, created, author, kind, item FROM posts JOIN added ON m = post_id % 11
  UNION ALL
  SELECT post_id, created, author, 'url', url FROM posts WHERE url IS NOT NULL
  UNION ALL
  SELECT post_id, created, author, 'keyword', keyword FROM posts
  JOIN keywords ON contains(lower(title || ' ' || selftext), lower(keyword))
)""",
)


ORACLES: dict[str, str] = {
    "read_posts": sql(
        select="SELECT post_id, created AS created_at, author, subreddit, title, "
        "md5(selftext) AS selftext, lang, score, comments, upvote_ratio, url, domain FROM posts"
    ),
    "flatten_struct": sql(
        select="SELECT post_id, title, score AS counts_score, comments AS counts_comments "
        "FROM posts"
    ),
    "resolve_timestamp_column": sql(
        select="SELECT post_id, 'created_utc' AS column_name, "
        "NOT (post_id % 7 <> 3 AND post_id % 11 = 5) AS present FROM posts"
    ),
    "parse_timestamp": sql(
        select=f"SELECT post_id, CASE WHEN NOT ({BAD_TIME}) THEN created END AS created_utc "
        "FROM posts"
    ),
    "drop_undated": sql(
        select=f'SELECT post_id, created AS "timestamp" FROM posts WHERE NOT ({BAD_TIME})'
    ),
    "choose_text_column": sql(
        select="SELECT post_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM ("
        "SELECT post_id, CASE WHEN post_id % 5 <> 2 THEN selftext ELSE '' END AS t FROM posts)"
    ),
    "derive_calendar": sql(
        select="SELECT post_id, CAST(created AS DATE) AS date, "
        "strftime(created, '%Y-%U') AS year_week, strftime(created, '%Y-%m') AS year_month, "
        "CAST(isodow(created) - 1 AS INTEGER) AS day_of_week, "
        "CAST(hour(created) AS INTEGER) AS hour FROM posts"
    ),
    "fill_schema_defaults": sql(
        select=f"SELECT post_id, '{fv.DEFAULT_SUBREDDIT}' AS subreddit, CAST(0 AS BIGINT) AS score, "
        "comments, substr(selftext, 1, 80) AS title FROM posts"
    ),
    "load_embeddings": sql(
        select="SELECT post_id, CAST(len(embedding) AS INTEGER) AS dims FROM posts JOIN embeddings ON vec_id = post_id"
    ),
    "ingest": sql(
        select="SELECT post_id, date_trunc('second', created) AS \"timestamp\", "
        "strftime(created, '%Y-%m') AS year_month, CAST(hour(created) AS INTEGER) AS hour, "
        "md5(selftext) AS text_md5, subreddit, comments FROM posts "
        "WHERE post_id % 10 <> 7 AND post_id % 10 <> 8 AND post_id % 10 <> 9"
    ),
    "prepare_embedding_text_cut": sql(
        PREPARED,
        select="SELECT post_id, CAST(least(n_tokens, 200) AS INTEGER) AS n_tokens, "
        "md5(CASE WHEN n_tokens > 200 THEN regexp_extract(text, '^(\\S+\\s+){199}\\S+') ELSE text END) AS text_md5 "
        "FROM prepared",
    ),
    "topic_cluster_checks": sql(
        select="SELECT count(*) AS posts_in, count(*) AS posts_out, "
        "CAST(greatest(2, least(5, count(*) // 8)) AS INTEGER) AS clusters, CAST(0 AS BIGINT) AS misplaced "
        "FROM posts WHERE trim(title) <> ''"
    ),
    "project_2d_checks": sql(
        select="SELECT count(*) AS posts, true AS uncorrelated, true AS best FROM posts WHERE trim(title) <> ''"
    ),
    "vector_mismatches": sql(
        select="SELECT coalesce(p.post_id, e.vec_id) AS post_id, "
        "CAST(p.post_id IS NOT NULL AS BIGINT) AS n_posts, "
        "CAST(e.vec_id IS NOT NULL AS BIGINT) AS n_vectors "
        "FROM posts p FULL JOIN embeddings e ON e.vec_id = p.post_id "
        "WHERE p.post_id IS NULL OR e.vec_id IS NULL"
    ),
    "prepare_embedding_text": sql(
        PREPARED, select="SELECT post_id, n_tokens, md5(text) AS text_md5 FROM prepared"
    ),
    "token_budget_batches": sql(
        PREPARED,
        f"""
summed AS (
  SELECT post_id, n_tokens, row_number() OVER (ORDER BY post_id) AS i, sum(n_tokens) OVER (ORDER BY post_id) AS upto FROM prepared
),
edges AS (
  SELECT upto AS x, 0 AS asked, i FROM summed UNION ALL SELECT upto - n_tokens + {fv.MAX_TOKENS}, 1, i FROM summed
),
following AS (
  SELECT * FROM (SELECT i, asked, min(CASE WHEN asked = 0 THEN i END) OVER
    (ORDER BY x, asked ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS j FROM edges) WHERE asked = 1
),
begins AS (
  SELECT CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS batch
  UNION ALL SELECT f.j, s.batch + 1 FROM begins s JOIN following f ON f.i = s.i WHERE f.j IS NOT NULL
)""",
        select="SELECT post_id, max(batch) OVER (ORDER BY summed.i) AS batch, n_tokens FROM summed LEFT JOIN begins ON begins.i = summed.i",
        recursive=True,
    ),
    "write_embeddings": sql(
        select="SELECT post_id, CAST(len(embedding) AS INTEGER) AS dims, "
        "round(list_sum(embedding::DOUBLE[]), 6) AS total "
        "FROM posts JOIN embeddings ON vec_id = post_id"
    ),
    "date_bounds": sql(
        select="SELECT CAST(min(created) AS DATE) AS min_date, "
        "CAST(max(created) AS DATE) AS max_date FROM posts"
    ),
    "filter_date_range": sql(
        select='SELECT post_id, created AS "timestamp", author, subreddit FROM posts '
        f"WHERE CAST(created AS DATE) BETWEEN DATE '{fx.START}' AND DATE '{fx.END}'"
    ),
    "filter_viral": sql(select="SELECT post_id, score FROM posts WHERE score > 100"),
    "filter_title_keyword": sql(
        select="SELECT post_id, title FROM posts "
        f"WHERE regexp_matches(title, '(?i){fx.TITLE_PATTERN}')"
    ),
    "filter_nonblank_title": sql(
        select="SELECT post_id, title FROM posts WHERE post_id % 3 <> 1 AND post_id % 9 <> 2 AND trim(title) <> ''"
    ),
    "project_result_table": sql(
        SENTIMENT,
        select='SELECT created AS "timestamp", subreddit, title, score, comments, '
        + "CASE sent_label "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.SENTIMENT_DISPLAY.items())
        + " END AS sent_label, url FROM scored",
    ),
    "lookup_post": sql(
        select=f"SELECT post_id, title, url FROM posts WHERE post_id = {fx.LOOKUP_POST}"
    ),
    "align_embeddings": sql(
        select="SELECT post_id, subreddit, CAST(i - 1 AS INTEGER) AS dim, "
        "round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM ("
        "SELECT post_id, subreddit, embedding, generate_subscripts(embedding, 1) AS i "
        "FROM posts JOIN embeddings ON vec_id = post_id)"
    ),
    "semi_join_top_authors": sql(
        EDGES,
        select="SELECT post_id, author, subreddit FROM posts "
        "WHERE author IN (SELECT author FROM best_authors)",
    ),
    "reindex_weekdays": sql(
        f"week(day_of_week, day) AS (VALUES {values(enumerate(fv.WEEKDAYS))})",
        select="SELECT w.day_of_week, w.day, coalesce(CAST(c.n AS VARCHAR), 'missing') AS posts "
        "FROM week w LEFT JOIN (SELECT isodow(created) - 1 AS d, count(*) AS n FROM posts "
        "GROUP BY 1) c ON c.d = w.day_of_week",
    ),
    "sentiment_lexicon_join": sql(
        SENTIMENT,
        select="SELECT post_id, word, count(*) AS n, round(sum(valence), 6) AS valence "
        "FROM tokens JOIN lexicon ON word = lower(token) GROUP BY post_id, word",
    ),
    "similarity_scores": sql(
        MATCHED,
        select="SELECT post_id, round(similarity_score, 6) AS similarity_score FROM matched",
    ),
    "search_top_k": sql(
        MATCHED,
        select='SELECT post_id, created AS "timestamp", author, subreddit, title, '
        "round(matched.similarity_score, 6) AS similarity_score FROM matched "
        "ORDER BY matched.similarity_score DESC, post_id LIMIT 50",
    ),
    "search_balls": sql(
        MATCHED,
        select='SELECT post_id, created AS "timestamp", author, subreddit, title, '
        "round(matched.similarity_score, 6) AS similarity_score FROM matched "
        "ORDER BY matched.similarity_score DESC, post_id LIMIT 50",
    ),
    "search_filtered": sql(
        MATCHED,
        select='SELECT post_id, created AS "timestamp", subreddit, title, '
        "round(matched.similarity_score, 6) AS similarity_score FROM matched "
        f"WHERE {IN_RANGE} ORDER BY matched.similarity_score DESC, post_id LIMIT 50",
    ),
    "search_shared_link": sql(
        MATCHED,
        select="SELECT post_id, url, round(matched.similarity_score, 6) AS similarity_score FROM matched "
        "WHERE url = 'https://youtu.be/2' ORDER BY matched.similarity_score DESC, post_id LIMIT 20",
    ),
    "topic_weekly_trend": sql(
        """
hits AS (
  SELECT label AS cluster_id, CAST(CAST(created AS DATE) + (7 - CAST(isodow(created) AS INTEGER)) AS DATE) AS week
  FROM posts JOIN embeddings ON vec_id = post_id
),
spans AS (SELECT cluster_id, min(week) AS a, max(week) AS b FROM hits GROUP BY cluster_id),
weeks AS (
  SELECT cluster_id, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week FROM spans
)""",
        select="SELECT w.week, w.cluster_id, count(h.week) AS posts FROM weeks w "
        "LEFT JOIN hits h ON h.cluster_id = w.cluster_id AND h.week = w.week GROUP BY 1, 2",
    ),
    "search_many": sql(
        """
asked AS (
  SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0
),
pairs AS (
  SELECT query_id, post_id, round(list_dot_product(embedding::DOUBLE[], v), 9) AS s
  FROM posts JOIN embeddings ON vec_id = post_id, asked
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, post_id) AS rank FROM pairs
)""",
        select="SELECT query_id, CAST(rank AS INTEGER) AS rank, post_id, s AS similarity_score "
        "FROM placed WHERE rank <= 20",
    ),
    "cosine_top_k": sql(
        MATCHED,
        """
angles AS (
  SELECT post_id, title,
         list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)) AS s
  FROM posts JOIN embeddings ON vec_id = post_id
)""",
        select="SELECT post_id, title, round(s, 6) AS similarity_score FROM angles "
        "ORDER BY s DESC, post_id LIMIT 50",
    ),
    "sentiment_compound": sql(
        SENTIMENT, select="SELECT post_id, round(compound, 6) AS compound FROM sentiment"
    ),
    "sentiment_label": sql(SENTIMENT, select="SELECT post_id, sent_label FROM scored"),
    "sentiment_neutral_fallback": sql(
        select="SELECT post_id, 0e0 AS compound, 'neutral' AS sent_label FROM posts"
    ),
    "sentiment_share_by_cluster": sql(
        SENTIMENT,
        LABELLED,
        select="SELECT cluster_label AS cluster, "
        + ", ".join(
            f"round(count(*) FILTER (sent_label = '{x}') * 1e0 / count(*), 6) "
            f"AS \"{x.capitalize()}\""
            for x in fv.SENTIMENT_LABELS
        )
        + " FROM labelled GROUP BY cluster_label",
    ),
    "posts_by_day": sql(
        DAILY, select="SELECT day AS date, day AS plot_date, n AS posts FROM daily"
    ),
    "posts_by_week": sql(
        select="SELECT strftime(created, '%Y-%U') AS year_week, "
        "CAST(CAST(created AS DATE) - CAST(dayofweek(created) AS INTEGER) AS DATE) AS plot_date, "
        "count(*) AS posts FROM posts GROUP BY 1, 2"
    ),
    "posts_by_month": sql(
        select="SELECT strftime(created, '%Y-%m') AS year_month, "
        "CAST(date_trunc('month', created) AS DATE) AS plot_date, count(*) AS posts "
        "FROM posts GROUP BY 1, 2"
    ),
    "posts_by_day_subreddit": sql(
        select="SELECT CAST(created AS DATE) AS date, subreddit, count(*) AS posts FROM posts "
        "WHERE subreddit IS NOT NULL GROUP BY 1, 2"
    ),
    "peak_day": sql(
        DAILY, select="SELECT day AS date, n AS posts FROM daily ORDER BY n DESC, day LIMIT 1"
    ),
    "peak_and_trough": sql(
        facts("posts", "|"),
        select="SELECT peak_date, peak_posts, trough_date, trough_posts FROM facts",
    ),
    "weekday_rhythm": sql(
        f"week(day_of_week, day) AS (VALUES {values(enumerate(fv.WEEKDAYS))})",
        select="SELECT w.day, c.n AS posts "
        "FROM week w LEFT JOIN (SELECT isodow(created) - 1 AS d, count(*) AS n FROM posts "
        "GROUP BY 1) c ON c.d = w.day_of_week",
    ),
    "keyword_weekly_trend": sql(
        f"keywords(keyword) AS (VALUES {values([(k,) for k in fx.KEYWORDS])})",
        """
hits AS (
  SELECT keyword,
         CAST(CAST(created AS DATE) + (7 - CAST(isodow(created) AS INTEGER)) AS DATE) AS week
  FROM posts JOIN keywords ON regexp_matches(title, '(?i)' || keyword)
),
spans AS (SELECT keyword, min(week) AS a, max(week) AS b FROM hits GROUP BY keyword),
weeks AS (
  SELECT keyword, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week FROM spans
)""",
        select="SELECT w.week, w.keyword, count(h.week) AS posts FROM weeks w "
        "LEFT JOIN hits h ON h.keyword = w.keyword AND h.week = w.week GROUP BY 1, 2",
    ),
    "keyword_index_trend": sql(
        f"keywords(keyword) AS (VALUES {values([(k,) for k in dict.fromkeys(fx.KEYWORDS + fx.STOP_WORDS)])})",
        """
hits AS (
  SELECT keyword,
         CAST(CAST(created AS DATE) + (7 - CAST(isodow(created) AS INTEGER)) AS DATE) AS week
  FROM posts JOIN keywords ON regexp_matches(title, '(?i)' || keyword)
),
spans AS (SELECT keyword, min(week) AS a, max(week) AS b FROM hits GROUP BY keyword),
weeks AS (
  SELECT keyword, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week FROM spans
)""",
        select="SELECT w.week, w.keyword, count(h.week) AS posts FROM weeks w "
        "LEFT JOIN hits h ON h.keyword = w.keyword AND h.week = w.week GROUP BY 1, 2",
    ),
    "dataset_overview": sql(
        select="SELECT count(*) AS total_posts, count(DISTINCT subreddit) AS active_subreddits, "
        "count(DISTINCT author) AS active_authors, count(*) FILTER (score > 100) AS viral_posts "
        "FROM posts"
    ),
    "top_subreddits": sql(
        select="SELECT subreddit, count(*) AS posts FROM posts WHERE subreddit IS NOT NULL "
        "GROUP BY 1 ORDER BY posts DESC, subreddit LIMIT 10"
    ),
    "subreddit_counts": sql(
        select="SELECT subreddit, count(*) AS posts FROM posts WHERE subreddit IS NOT NULL "
        "GROUP BY 1"
    ),
    "score_stats": sql(
        SCORE_STATS.format(source="posts"),
        select="SELECT round(avg_score, 6) AS avg_score, max_score, min_score, "
        "round(median_score, 6) AS median_score, round(p90_score, 6) AS p90_score, "
        "round(score_std, 6) AS score_std FROM stats",
    ),
    "score_stats_fractional": sql(
        SCORE_STATS.format(source="(SELECT score * upvote_ratio AS score FROM posts)"),
        select="SELECT round(avg_score, 6) AS avg_score, round(max_score, 6) AS max_score, round(min_score, 6) AS min_score, "
        "round(median_score, 6) AS median_score, round(p90_score, 6) AS p90_score, "
        "round(score_std, 6) AS score_std FROM stats",
    ),
    "media_impact": sql(
        select=f"SELECT {MEDIA_TYPE} AS media_type, round(avg(posts.score), 6) AS score "
        "FROM posts GROUP BY 1"
    ),
    "top_images": sql(
        select=f"SELECT post_id, url, score FROM posts WHERE {MEDIA_TYPE} = 'Image' "
        "ORDER BY score DESC, post_id LIMIT 6"
    ),
    "content_composition": sql(
        f"classed AS (SELECT *, {CATEGORY} AS category FROM posts)",
        select="SELECT subreddit, category, CAST(grouping(category) AS INTEGER) AS level, "
        "count(*) AS posts, CAST(sum(greatest(score, 0) + 1) AS BIGINT) AS score_size, "
        "CAST(sum(greatest(comments, 0) + 1) AS BIGINT) AS comments_size "
        "FROM classed GROUP BY GROUPING SETS ((subreddit, category), (subreddit))",
    ),
    "viral_post": sql(
        MATCHED,
        select="SELECT post_id, title, score, "
        "round(matched.similarity_score, 6) AS similarity_score FROM matched "
        "ORDER BY score DESC, matched.similarity_score DESC, post_id LIMIT 1",
    ),
    "controversy_points": sql(
        select="SELECT post_id, title, subreddit, comments, score, "
        "round(upvote_ratio, 6) AS upvote_ratio, "
        "round(CASE WHEN comments > 0 THEN log10(comments) END, 6) AS log_comments, "
        "round(CASE WHEN score > 0 THEN log10(score) END, 6) AS log_score, "
        "round(least(greatest(upvote_ratio, 0.5e0), 1e0), 6) AS colour FROM posts"
    ),
    "community_share": sql(
        select="SELECT subreddit, count(*) AS posts, "
        "round(count(*) / sum(count(*)) OVER (), 6) AS share "
        "FROM posts WHERE subreddit IS NOT NULL GROUP BY subreddit"
    ),
    "clean_title": sql(CLEANED, select="SELECT post_id, cleaned FROM cleaned"),
    "tokenize_ngrams": sql(
        TERMS,
        select="SELECT p.post_id, coalesce(string_agg(term, '|' ORDER BY kind, i), '') AS terms, "
        "CAST(count(term) AS INTEGER) AS n FROM posts p LEFT JOIN terms t ON t.post_id = p.post_id "
        "GROUP BY p.post_id",
    ),
    "prune_vocabulary": sql(TERMS, select="SELECT term, df, tf FROM vocabulary"),
    "tfidf_weights": sql(
        TERMS, select="SELECT post_id, term, tf, round(weights.tfidf, 6) AS tfidf FROM weights"
    ),
    "top_keywords": sql(
        TERMS,
        select="SELECT term, round(sum(tfidf), 6) AS weight FROM weights GROUP BY term "
        "ORDER BY sum(tfidf) DESC, term LIMIT 50",
    ),
    "cluster_count_rule": sql(
        select="SELECT titles, CAST(greatest(2, least(5, titles // 8)) AS INTEGER) AS clusters "
        "FROM (SELECT count(*) AS titles FROM posts WHERE trim(title) <> '')"
    ),
    "cluster_top_terms": sql(
        TERMS,
        """
sizes AS (
  SELECT label, count(*) AS n FROM embeddings JOIN posts ON vec_id = post_id GROUP BY label
),
means AS (
  SELECT e.label, term, round(sum(tfidf) / any_value(n), 9) AS mean
  FROM weights w JOIN embeddings e ON e.vec_id = w.post_id JOIN sizes s ON s.label = e.label
  GROUP BY e.label, term
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean DESC, term) AS rank FROM means
)""",
        select="SELECT label AS cluster_id, CAST(rank AS INTEGER) AS rank, term, "
        "round(mean, 6) AS weight FROM placed WHERE rank <= 6",
    ),
    "cluster_profile": sql(
        SENTIMENT,
        LABELLED,
        select="SELECT cluster_id, count(*) AS size, round(avg(compound), 6) AS avg_compound, "
        + ", ".join(
            f"round(count(*) FILTER (sent_label = '{x}') * 1e0 / count(*), 6) AS {x}_share"
            for x in fv.SENTIMENT_LABELS
        )
        + " FROM labelled GROUP BY cluster_id",
    ),
    "cluster_examples": sql(
        MATCHED,
        """
placed AS (
  SELECT e.label AS cluster_id, post_id, title, row_number() OVER (
    PARTITION BY e.label ORDER BY similarity_score DESC, post_id) AS rank
  FROM matched JOIN embeddings e ON e.vec_id = post_id
)""",
        select="SELECT cluster_id, CAST(rank AS INTEGER) AS rank, post_id, title FROM placed "
        "WHERE rank <= 3",
    ),
    "projection_centroids": "SELECT 'Cluster ' || label AS cluster_label, "
    "round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x, "
    "round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y FROM embeddings GROUP BY label",
    "categorize_domain": sql(select=f"SELECT post_id, domain, {CATEGORY} AS category FROM posts"),
    "detect_media_type": sql(select=f"SELECT post_id, url, {MEDIA_TYPE} AS media_type FROM posts"),
    "context_links": sql(
        """
peaks AS (
  SELECT post_id, 'news from ' || subreddit AS query,
         CASE WHEN post_id % 9 = 4 THEN NULL WHEN post_id % 10 = 7 THEN 'None'
              ELSE CAST(CAST(created AS DATE) AS VARCHAR) END AS peak_date
  FROM posts
),
days AS (SELECT *, TRY_CAST(peak_date AS DATE) AS d FROM peaks)""",
        select="SELECT post_id, query, peak_date, CASE WHEN d IS NULL THEN '' ELSE "
        + "'https://www.google.com/search?q=' || replace(query, ' ', '+') || "
        "'&tbs=cdr:1,cd_min:' || strftime(d - INTERVAL 1 DAY, '%m/%d/%Y') || ',cd_max:' || "
        "strftime(d + INTERVAL 1 DAY, '%m/%d/%Y') || '&tbm=nws' END AS news_url, "
        "CASE WHEN d IS NULL THEN '' ELSE "
        "'https://en.wikipedia.org/wiki/Portal:Current_events/' || strftime(d, '%B_%Y') END "
        "AS encyclopedia_url FROM days",
    ),
    "top_authors": sql(EDGES, select="SELECT author, n AS posts FROM best_authors"),
    "network_edges": sql(EDGES, select="SELECT author, subreddit, n AS posts FROM edges"),
    "network_nodes": sql(
        EDGES,
        select="SELECT DISTINCT author AS node, 'Author' AS node_type, 10e0 AS size FROM edges "
        "UNION ALL SELECT subreddit, 'Subreddit', 20e0 + 1.5e0 * count(*) FROM edges "
        "GROUP BY subreddit",
    ),
    "network_counts": sql(
        EDGES,
        select="SELECT count(DISTINCT subreddit) AS subreddits, "
        "count(DISTINCT author) AS authors, count(*) AS connections FROM edges",
    ),
    "briefing_facts": sql(
        facts("posts", "|"),
        select="SELECT total, start_date, end_date, round(avg_score, 6) AS avg_score, max_score, "
        "min_score, round(median_score, 6) AS median_score, round(p90_score, 6) AS p90_score, "
        "round(score_std, 6) AS score_std, peak_date, peak_posts, trough_date, trough_posts, "
        "top_subreddits FROM facts",
    ),
    "suggestion_context": sql(
        MATCHED, suggestions("|", "|"), select="SELECT titles, subreddits FROM suggestion"
    ),
    "chat_context": sql(
        MATCHED,
        SENTIMENT,
        chat("'|'", "title || ';' || subreddit || ';' || score || ';' || sent_label"),
        select="SELECT total, viral_title, viral_score, top_subreddit, first_rows FROM chat",
    ),
    "render_prompts": sql(
        MATCHED,
        SENTIMENT,
        facts("matched", ", "),
        suggestions(" / ", ", "),
        chat("chr(10)", "title || ' | ' || subreddit || ' | ' || score || ' | ' || sent_label"),
        select="""
SELECT 'briefing' AS kind,
       'Write an analyst briefing about posts that match: harbour' || chr(10) ||
       'Posts: ' || total || ', from ' || start_date || ' to ' || end_date || chr(10) ||
       'Score mean ' || printf('%.2f', round(avg_score, 2)) || ', median ' || printf('%.2f', round(median_score, 2)) ||
       ', 90th percentile ' || printf('%.2f', round(p90_score, 2)) || ', deviation ' ||
       printf('%.2f', round(score_std, 2)) || ', from ' || min_score || ' to ' || max_score || chr(10) ||
       'Busiest day ' || peak_date || ' with ' || peak_posts || ' posts, quietest day ' ||
       trough_date || ' with ' || trough_posts || chr(10) ||
       'Leading communities: ' || top_subreddits || chr(10) ||
       'Cover strength of the signal, communities, engagement, timing and an outlook. ' ||
       'Use only these figures.' AS prompt
FROM facts
UNION ALL
SELECT 'suggestions',
       'Posts were searched for: harbour' || chr(10) || 'Communities: ' || subreddits || chr(10) ||
       'Titles: ' || titles || chr(10) ||
       'Give three short analytical questions about these posts, ' ||
       'separated by a vertical bar and nothing else.'
FROM suggestion
UNION ALL
SELECT 'chat',
       'Answer from these facts and rows only.' || chr(10) ||
       'Top post: ' || viral_title || ' (score ' || viral_score || '). Leading community: ' ||
       top_subreddit || '. Posts: ' || total || '.' || chr(10) ||
       first_rows || chr(10) || 'Question: Who posts most?'
FROM chat""",
    ),
    "parse_suggestions": f"""
WITH replies AS (
  SELECT doc_id, CASE WHEN doc_id % 13 <> 4 THEN text END AS reply,
         doc_id % 17 <> 6 AS has_posts
  FROM documents
),
parts AS (
  SELECT doc_id, unnest(string_split(reply, '|')[1:3]) AS part,
         generate_subscripts(string_split(reply, '|')[1:3], 1) AS i
  FROM replies WHERE reply IS NOT NULL
),
split AS (
  SELECT doc_id, list(trim(part, ' ' || chr(9) || chr(10) || chr(13)) ORDER BY i) AS found
  FROM parts GROUP BY doc_id
),
chosen AS (
  SELECT doc_id, CASE WHEN NOT has_posts THEN {FIXED_EMPTY}
                      ELSE coalesce(found, {FIXED_FAILED}) END AS questions
  FROM replies LEFT JOIN split USING (doc_id)
)
SELECT doc_id, CAST(len(questions) AS INTEGER) AS n,
       md5(array_to_string(questions, '|')) AS questions_md5
FROM chosen""",
    "metadata_summary": sql(
        DAILY,
        select="""
SELECT 'total_posts' AS section, NULL AS name, count(*) AS number FROM posts
UNION ALL SELECT 'start_date', CAST(CAST(min(created) AS DATE) AS VARCHAR), NULL FROM posts
UNION ALL SELECT 'end_date', CAST(CAST(max(created) AS DATE) AS VARCHAR), NULL FROM posts
UNION ALL SELECT 'subreddit', subreddit, count(*) FROM posts WHERE subreddit IS NOT NULL GROUP BY 2
UNION ALL SELECT 'day', CAST(day AS VARCHAR), n FROM daily
UNION ALL SELECT 'top_post', CAST(post_id AS VARCHAR), score FROM (
  SELECT post_id, score FROM posts ORDER BY score DESC, post_id LIMIT 10)""",
    ),
    "corrupt_line_report": sql(
        "good AS (SELECT *, post_id % 6 <> 1 AS fine FROM posts)",
        select="""
SELECT 'corrupt' AS problem, count(*) FILTER (NOT fine) AS lines FROM good
UNION ALL SELECT 'missing author', count(*) FILTER (fine AND author IS NULL) FROM good
UNION ALL SELECT 'missing title', count(*) FILTER (fine AND title IS NULL) FROM good
UNION ALL SELECT 'missing url', count(*) FILTER (fine AND url IS NULL) FROM good
UNION ALL SELECT 'missing domain', count(*) FILTER (fine AND domain IS NULL) FROM good
UNION ALL SELECT 'missing score', count(*) FILTER (fine) FROM good""",
    ),
    "sharing_network": sql(
        *SHARED_ITEMS,
        select="SELECT author, kind, item, count(DISTINCT post_id) AS posts FROM items "
        "WHERE author IS NOT NULL GROUP BY author, kind, item",
    ),
    "co_sharing_accounts": sql(
        *SHARED_ITEMS,
        select="SELECT a.author, b.author AS other, count(DISTINCT a.kind || ' ' || a.item) AS items "
        "FROM items a JOIN items b ON a.kind = b.kind AND a.item = b.item AND a.author < b.author "
        f"AND abs(epoch_us(a.created) - epoch_us(b.created)) <= {fx.CO_SHARING_SECONDS * 1_000_000} "
        "GROUP BY 1, 2 HAVING count(DISTINCT a.kind || ' ' || a.item) >= 2",
    ),
}
