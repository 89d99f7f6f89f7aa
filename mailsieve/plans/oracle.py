"""SQL twins of the registered queries, written for DuckDB."""

from __future__ import annotations

from mailsieve import fixed_values as V
from mailsieve.functions.reasons import SERVICE_SENTENCES
from mailsieve.operators import sampling as T
from mailsieve.plans import views as W

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def even(x: str, digits: int) -> str:
    f = float(10**digits)
    return f"(round_even(({x}) * {f}, 0) / {f})"


def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{V.WS}]+', ' ', 'g'))"


def basic(x: str) -> str:
    return sq(f"coalesce({x}, '')")


def tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def html(x: str) -> str:
    return sq(tags(f"coalesce({x}, '')"))


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{V.WS}]+', ''), '[{V.WS}]+$', '')"


def blank(x: str) -> str:
    return f"({strip(f'coalesce({x}, {q(str())})')} = '')"


def norm(x: str, url: str) -> str:
    step = f"regexp_replace(lower({html(x)}), {q(V.EMAIL_ADDRESS)}, ' <EMAIL> ', 'g')"
    return sq(f"regexp_replace({step}, {q(url)}, ' <URL> ', 'g')")


def urls(x: str, url: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {q(url)}), lambda u: trim(u, {q(V.URL_EDGE_CHARS)}))"


def entropy(x: str) -> str:
    """Textbook form: minus the sum of p * log2(p)."""
    counts = f"map_values(list_histogram(regexp_extract_all({x}, '(?s).')))"
    n = f"length({x})"
    return (
        f"case when {n} = 0 then 0.0::double else greatest(-list_sum(list_transform({counts}, "
        f"lambda k: (k / {n}::double) * log2(k / {n}::double))), 0.0::double) end"
    )


def hits(x: str, items) -> str:
    return f"list_filter({words(items)}, lambda w: contains({x}, w))"


def language(x: str) -> str:
    si, ta, la = (f"regexp_matches({x}, {q(p)})" for p in (V.SINHALA, V.TAMIL, V.LATIN))
    return (
        f"case when {si} and {la} then 'CodeMixed_Sinhala_English' when {ta} and {la} then 'CodeMixed_Tamil_English' "
        f"when {si} then 'Sinhala' when {ta} then 'Tamil' when {la} then 'English' else 'Unknown' end"
    )


# --- common table expressions --------------------------------------------------

CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTE[name] = (needs, body)


def sql(needs: list[str], body: str) -> str:
    """Prefix a statement with the expressions it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTE[name][0]:
            visit(need)
        order.append(name)

    for name in needs:
        visit(name)
    listed = ",\n".join(f"{n} as ({CTE[n][1]})" for n in order)
    # A body may open with ``, name as (...)`` or with its own WITH and so go on with the list.
    if order and body.startswith("with "):
        body = ", " + body[5:]
    return (f"with {listed}\n" if order else "") + body


def oracle(name: str, needs: list[str], body: str) -> None:
    ORACLE[name] = sql(needs, body)


def plain(view: str) -> str:
    for t in W.TABLES:
        view = view.replace("{" + t + "}", t)
    return view


cte("emails", [], """
with n as (select count(*) as np from pages),
base as (
  select d.doc_id, d.source, split_part(d.text, chr(10), 1) as subject,
         substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) as rest,
         d.doc_id % 5 as k, (d.doc_id % 10) >= 5 as alt, p.url, l.quality, l.toxic
  from documents d cross join n
  left join pages p on p.page_id = d.doc_id % n.np
  left join labels l on l.doc_id = d.doc_id)
select doc_id as email_id, source as source_dataset,
  concat('u', cast(doc_id % 97 as varchar), '@mail', cast(doc_id % 7 as varchar), '.example.test') as sender,
  case when doc_id % 11 = 0 then null else concat('r', cast(doc_id % 13 as varchar), '@in.example.test') end as receiver,
  subject,
  case k when 0 then rest
    when 1 then concat(rest, ' Claim the prize <b>now</b>: click ', url, '.')
    when 2 then case when alt
        then concat(rest, ' ඔබේ ගිණුම verify කරන්න hxxps://bank', cast(doc_id % 9 as varchar), '[.]test/login')
        else concat(rest, ' உங்கள் கணக்கு update hxxp://pay-a-b-c', cast(doc_id % 9 as varchar), '[.]test/reset') end
    when 3 then concat(rest, ' Urgent invoice: wire the payment, write to ceo', cast(doc_id % 5 as varchar), '@corp.example.test')
    else concat(rest, ' Kindly confirm your account at www.acc0unt-help.test/u?id=', cast(doc_id as varchar)) end as body,
  case k when 0 then 'Legitimate' when 1 then 'Spam' when 2 then 'Traditional_Phishing'
         when 3 then 'Business_Email_Compromise' else 'AI_Generated_Phishing' end as category,
  quality, toxic
from base""")
cte("mail_headers", [], plain(W.MAIL_HEADERS))
cte("attachments", [], plain(W.ATTACHMENTS))
cte("predictions", [], plain(W.PREDICTIONS))
cte("feedback", [], plain(W.FEEDBACK))


def feature_cte(name: str, source: str, url: str, keywords) -> None:
    """Staged, so that each text is computed once."""
    given = "" if source != "code_mixed" else " exclude (email_text, urls)"
    cte(name + "_clean", [source], f"""
select *{given} replace ({html('subject')} as subject, {html('body')} as body) from {source} where not ({blank('subject')} and {blank('body')})""")
    cte(name + "_texts", [name + "_clean"], f"select *, trim(concat(subject, ' ', body)) as email_text from {name}_clean")
    cte(name + "_norm", [name + "_texts"], f"""
select *, {norm('email_text', url)} as clean_email_text, {urls('email_text', url)} as urls from {name}_texts""")
    cte(name, [name + "_norm"], f"""
select *, len(urls)::int as url_count_extracted, (len(urls) > 0)::int as has_url,
  regexp_matches(email_text, {q(V.DEFANGED)})::int as has_defanged_url,
  length(email_text)::int as text_char_count,
  (case when email_text = '' then 0 else len(string_split(email_text, ' ')) end)::int as text_word_count,
  length(subject)::int as subject_char_count, length(body)::int as body_char_count,
  len({hits('lower(email_text)', keywords)})::int as suspicious_keyword_count,
  {even(entropy('clean_email_text'), 4)} as email_entropy,
  {language('email_text')} as detected_language from {name}_norm""")


feature_cte("feats", "emails", V.TRAINING_URL, V.TRAINING_KEYWORDS)
feature_cte("feats_serving", "emails", V.SERVING_URL, V.SERVING_KEYWORDS)
FEATURES = ", ".join(V.STRUCTURED_COLUMNS)

cte("url_lists", ["emails"], f"""
select email_id, {urls(f"trim(concat({html('subject')}, ' ', {html('body')}))", V.TRAINING_URL)} as urls from emails""")
cte("url_rows", ["url_lists"], """
select 'mail' as src, email_id as id, unnest(range(0, len(urls)))::int as pos, unnest(urls) as raw_url from url_lists
union all select 'page', page_id, 0::int, url from pages""")

cte("raw", ["emails"], """
select email_id, source_dataset, sender, receiver, subject, body, cast(email_id % 2 as varchar) as label,
  case when email_id % 3 = 0 then 'n/a' when email_id % 3 = 1 then '2.0' end as urls,
  case when email_id % 4 = 0 then null else ' Mon,  1 Jan ' end as date from emails""")
cte("master", ["raw"], f"""
select email_id,
  case email_id % 4 when 0 then 'Enron' when 1 then 'SpamAssasin' when 2 then 'Nazario' else 'Nigerian_Fraud' end as source_dataset,
  {basic('sender')} as sender, {basic('receiver')} as receiver, {basic('date')} as date, {basic('subject')} as subject,
  {basic('body')} as body, trim(concat({basic('subject')}, ' ', {basic('body')})) as email_text,
  case when email_id % 4 = 3 then '' else coalesce(urls, '0') end as urls, label as original_label,
  case when email_id % 4 = 2 then 'Traditional_Phishing' when email_id % 4 = 3 then 'Business_Email_Compromise'
    when label = '0' then 'Legitimate' else 'Spam' end as category,
  case when email_id % 4 = 2 then 2 when email_id % 4 = 3 then 3 when label = '0' then 0 else 1 end::int as label,
  'English' as language
from raw""")
cte("gapped", ["raw"], """
select email_id, sender, receiver, date, urls, case when email_id % 10 = 3 then null else subject end as subject,
  case when email_id % 20 = 3 then '  ' else body end as body from raw""")
TO_INT = "coalesce(trunc(try_cast(urls as double))::int, 0)"
cte("filled", ["gapped"], f"""
select email_id, coalesce(sender, 'unknown_sender') as sender, coalesce(receiver, 'unknown_receiver') as receiver,
  coalesce(date, 'unknown_date') as date, {TO_INT} as urls, coalesce(subject, '') as subject, coalesce(body, '') as body from gapped""")


def pick(slot: str, choices) -> str:
    number = f"('0x' || substr(md5('42:{slot}:' || i), 1, 8))::bigint"
    return f"({words(choices)})[({number} % {len(choices)} + 1)::int]"


cte("code_mixed", [], f"""
select printf('CM_%06d', i) as email_id, 'Synthetic_CodeMixed' as source_dataset,
  {pick('sender', T.SENDERS)} as sender, {pick('receiver', T.RECEIVERS)} as receiver, '' as date,
  {pick('subject', T.SUBJECTS)} as subject,
  case when i % 5 = 0 then {pick('opening', T.OPENINGS)} || ' ' || base else base end as body,
  1::int as urls, 'synthetic' as original_label,
  case when i % 5 = 0 then 'AI_Generated_Phishing' else 'Traditional_Phishing' end as category,
  case when i <= n // 2 then 'CodeMixed_Sinhala_English' else 'CodeMixed_Tamil_English' end as language,
  trim(subject || ' ' || body) as email_text, case when i % 5 = 0 then 4 else 2 end::int as label
from (select i, n, replace(replace(case when i <= n // 2 then {pick('body', T.SINHALA_BODIES)} else {pick('body', T.TAMIL_BODIES)} end,
    '{{url}}', {pick('url', T.LURES)}), '{{timeframe}}', {pick('timeframe', T.TIMEFRAMES)}) as base
  from (select doc_id + 1 as i, count(*) over () as n from documents))""")
feature_cte("cm_feats", "code_mixed", V.TRAINING_URL, V.TRAINING_KEYWORDS)

cte("version_two", ["feats", "cm_feats"], """
select email_id::varchar as email_id, category, null::varchar as date, detected_language, null::int as label, null::varchar as language,
  null::varchar as original_label, quality, receiver, subject, suspicious_keyword_count, email_entropy, url_count_extracted from feats
union all
select email_id, category, date, detected_language, label, language, original_label, null::int, receiver, subject,
  suspicious_keyword_count, email_entropy, url_count_extracted from cm_feats""")

cte("probs", [], """
select email_id, [p0 / s, p1 / s, p2 / s, p3 / s, p4 / s] as p from (
  select *, p0 + p1 + p2 + p3 + p4 as s from (
    select vec_id as email_id, """ + ", ".join(
    f"(1 + floor(abs(embedding[{i + 1}]::float) * 1000::float))::double as p{i}" for i in range(5)
) + " from embeddings))")

KEY = "('0x' || substr(md5('42:' || email_id), 1, 15))::bigint"
cte("splits", ["predictions"], f"""
select email_id, category, case when rn <= n * 70 // 100 then 'train' when rn <= n * 85 // 100 then 'validation' else 'test' end as split
from (select email_id, category, row_number() over (partition by category order by {KEY}, email_id) as rn,
  count(*) over (partition by category) as n from predictions)""")
cte("split_table", ["splits"], """
select category, count(*) filter (split = 'train') as train, count(*) filter (split = 'validation') as validation,
  count(*) filter (split = 'test') as test, count(*) as total from splits group by category""")
cte("sampled", ["predictions"], f"select email_id, category from predictions order by {KEY}, email_id limit 300")

cte("verdicts", ["feedback", "emails"], """
select f.*, f.id % (select count(*) from documents) as email_id,
  case when f.id % 13 = 0 then ' ' else e.subject end as subject, case when f.id % 13 = 0 then '' else e.body end as body
from feedback f join emails e on e.email_id = f.id % (select count(*) from documents)""")
REJECTED = f"""case when feedback_status not in ('Correct', 'Wrong') or feedback_status is null then 'status must be Correct or Wrong'
  when correct_category not in ({', '.join(q(x) for x in V.CLASSES)}) then 'unknown category'
  when {blank('subject')} and {blank('body')} then 'empty e-mail' end"""
JUDGED = """select f.*, p.prediction, p.confidence, p.category as branch_prediction, p.confidence - 0.125::double as branch_confidence
from {feats} f join predictions p on p.email_id = f.email_id"""
cte("judged", ["feats", "predictions"], JUDGED.format(feats="feats"))
cte("judged_serving", ["feats_serving", "predictions"], JUDGED.format(feats="feats_serving"))
cte("enriched", ["verdicts", "judged"], f"""
select v.id, v.email_id, v.feedback_status, v.correct_category, j.prediction as predicted_category, j.confidence as prediction_confidence,
  j.branch_prediction as xgboost_prediction, j.branch_confidence as xgboost_confidence, j.detected_language, j.url_count_extracted,
  j.has_url, j.has_defanged_url, j.suspicious_keyword_count, j.email_entropy, j.clean_email_text
from verdicts v join judged j on j.email_id = v.email_id where {REJECTED.replace('subject', 'v.subject').replace('body', 'v.body')} is null""")


# --- sources -----------------------------------------------------------------------

oracle("s1_corpus_scan", ["emails"], "select email_id, subject, body, category from emails")


def repaired(x: str) -> str:
    return f"coalesce(try_cast({x} as double), 0)::double"


oracle("s2_feature_repair", ["raw"], f"""select email_id, {repaired('urls')} as url_count_extracted,
  {', '.join(f'0.0::double as {n}' for n in V.NUMERIC_FEATURES if n not in ('url_count_extracted', 'email_entropy'))},
  (case email_id % 6 when 0 then 1.5 when 2 then -2500.0 when 4 then 3.0 else 0.0 end)::double as email_entropy, 'Unknown' as detected_language,
  case when email_id % 5 = 0 then 'Unknown' else source_dataset end as category,
  case when email_id % 7 = 0 then '' else coalesce(subject, '') end as clean_email_text from raw""")
oracle("s3_table_sink", ["feats"], f"select email_id, category, {', '.join(V.NUMERIC_FEATURES)} from feats")
cte("mail_vectors", [], """select d.doc_id as email_id, e.embedding from documents d
  join embeddings e on e.vec_id = d.doc_id % (select count(*) from embeddings)""")
oracle("s4_array_store", ["mail_vectors"], """select email_id, 'train' as split, len(embedding) as width,
  embedding[1]::double as first, embedding[len(embedding)]::double as last from mail_vectors where email_id % 10 < 7""")
oracle("s5_run_metadata", ["splits"], f"""select 128::int as max_length, (select max(len(embedding)) from embeddings)::int as embedding_dimension,
  {q(' | '.join(V.CLASSES_SORTED))} as class_names, count(*) filter (split = 'train') as train_rows,
  count(*) filter (split = 'validation') as validation_rows, count(*) filter (split = 'test') as test_rows from splits""")
oracle("s6_feedback_store", ["feedback"], """select row_number() over (order by id) as id, id as event_id, feedback_status,
  correct_category, count(*) over () as total from feedback""")

# --- text -----------------------------------------------------------------------------

oracle("p1_clean_basic", ["emails"], f"select email_id, {basic('receiver')} as receiver, {basic('subject')} as subject, {basic('body')} as body from emails")
oracle("p2_clean_html", ["emails"], f"""select 'page' as src, page_id as id, {html('html')} as text from pages
union all select 'mail', email_id, {html('body')} from emails""")
oracle("p3_email_text", ["emails"], f"select email_id, trim(concat({basic('subject')}, ' ', {basic('body')})) as email_text from emails")
oracle("p4_normalize", ["emails"], f"""select 'mail' as src, email_id as id, {norm("concat_ws(' ', subject, body, sender)", V.TRAINING_URL)} as text from emails
union all select 'page', page_id, {norm("concat_ws(' ', html, url)", V.TRAINING_URL)} from pages""")
oracle("p5_standardize", ["master"], "select * from master")
oracle("p6_fill_missing", ["filled"], "select * from filled")
oracle("p7_missing_flags", ["filled"], """select sum((sender = 'unknown_sender')::int)::bigint as sender_missing,
  sum((receiver = 'unknown_receiver')::int)::bigint as receiver_missing, sum((date = 'unknown_date')::int)::bigint as date_missing from filled""")


def lines(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[{V.LINE_SEP}]'), "
        f"lambda x: {strip(f'regexp_replace(x, {q(chr(91) + chr(32) + chr(92) + chr(116) + chr(93) + chr(43))}, {q(chr(32))}, {q(chr(103))})')}), lambda x: x <> '')"
    )


SUBJECT_LINE = rf"(?i)^(?:subject|sub)[{V.WS}]*[:\-][{V.WS}]*(.+)$"
cte("shots", [], """
select 'doc' as src, doc_id as id, 0::bigint as turn, case doc_id % 4 when 0 then 'From: a@b.test' || chr(10) || chr(10) || ' SUB -  ' || text
  when 1 then 'To: x' || chr(10) || 'hi' || chr(10) || text when 2 then 'ok' || chr(9) || chr(9) || text || chr(10) || 'Subject:' || chr(9) || 'last  line '
  else text end as text from documents
union all
select 'turn', conv_id, turn, case turn when 0 then role || ': ' || text when 1 then 'a' || chr(10) || chr(10) || 'to: b' else text end from conversations""")
cte("shot_lines", ["shots"], f"select src, id, turn, {lines('text')} as ls from shots")
cte("shot_marks", ["shot_lines"], f"""select *, list_position(list_transform(ls, lambda x: regexp_matches(x, {q(SUBJECT_LINE)})), true) as li,
  list_position(list_transform(ls, lambda x: length(x) >= 3 and not ({' or '.join(f'starts_with(lower(x), {q(p)})' for p in V.METADATA_PREFIXES)})), true) as pi
from shot_lines""")
REST = "coalesce(array_to_string(ls[{i} + 1:], chr(10)), '')"
oracle("p8_split_subject", ["shot_marks"], f"""select src, id, turn,
  case when li > 0 then {strip(f"regexp_extract(ls[li], {q(SUBJECT_LINE)}, 1)")} when pi > 0 then ls[pi] else '' end as subject,
  case when li > 0 then {REST.format(i='li')} when pi > 0 then {REST.format(i='pi')} else coalesce(array_to_string(ls, chr(10)), '') end as body,
  case when len(ls) = 0 then 'no readable text' when li > 0 then '' when pi > 0 then 'subject estimated from the first meaningful line'
    else 'subject not identified' end as warning from shot_marks""")
oracle("p9_ocr_confidence", [], f"""select user_id as image, coalesce({even('avg(case when x >= 0 then x end) / 100.0', 4)}, 0.0::double) as ocr_confidence
from (select user_id, try_cast(case event_type when 'error' then '-1' when 'view' then 'n/a' else cast(event_id % 101 as varchar) end as double) as x from events)
group by user_id""")

TAIL = """(?:[^>"']|"[^"]*"|'[^']*')*"""
HTML_STEPS = [
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (r"(?is)<script(?:[\s/][^>]*)?>.*?(?:</script(?:[\s/][^>]*)?>|\z)", ""),
    (r"(?is)<style(?:[\s/][^>]*)?>.*?(?:</style(?:[\s/][^>]*)?>|\z)", ""),
    (r"<[!?][^>]*>", ""),
    (rf"(?i)</?(?:{'|'.join(V.BLOCK_TAGS)})(?:[\s/]{TAIL})?>", "\n"),
    (rf"</?[a-zA-Z]{TAIL}>", ""),
]


def html_text(x: str) -> str:
    for pattern, new in HTML_STEPS:
        x = f"regexp_replace({x}, {q(pattern)}, {'chr(10)' if new else q('')}, 'g')"
    # The references that occur in web pages and mail most often; the ampersand is decoded twice.
    x = f"regexp_replace(regexp_replace({x}, '&amp;?', '&', 'g'), '&amp;?', '&', 'g')"
    for old, new in [
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"),
        ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&eacute;", "é"), ("&#39;", "'"), ("&#x27;", "'"),
    ]:
        x = f"replace({x}, {q(old)}, {q(new)})"
    cleaned = f"list_transform(regexp_split_to_array({x}, '[{V.LINE_SEP}]'), lambda l: {sq('l')})"
    return f"coalesce(array_to_string(list_filter({cleaned}, lambda l: l <> ''), chr(10)), '')"


oracle("p10_html_to_text", [], f"select page_id, {html_text('html')} as text from pages")
oracle("p11_display_name", ["predictions"], "select email_id, replace(prediction, '_', ' ') as shown from predictions")
oracle("p12_truncate", [], "select doc_id, substr(text, 1, 5000) as text from documents")

# --- features ----------------------------------------------------------------------------

oracle("f1_extract_urls", ["url_lists"], "select email_id, unnest(range(0, len(urls)))::int as pos, unnest(urls) as url from url_lists")
oracle("f2_url_columns", ["url_lists"], """select email_id, len(urls)::int as url_count_extracted, (len(urls) > 0)::int as has_url,
  coalesce(array_to_string(urls, ' | '), '') as extracted_urls from url_lists""")
oracle("f3_defanged", ["emails"], f"select email_id, regexp_matches(body, {q(V.DEFANGED)})::int as has_defanged_url from emails")
oracle("f4_lengths", ["emails"], f"""select email_id, length(body)::int as body_char_count, length(subject)::int as subject_char_count,
  len(list_filter(regexp_split_to_array(body, '[{V.WS}]+'), lambda w: w <> ''))::int as body_word_count from emails""")
oracle("f5_keyword_count", ["emails"], f"""select email_id, len({hits("lower(concat_ws(' ', subject, body))", V.TRAINING_KEYWORDS)})::int as training_count,
  len({hits("lower(concat_ws(' ', subject, body))", V.SERVING_KEYWORDS)})::int as serving_count from emails""")
oracle("f6_keyword_list", ["emails"], f"""select email_id,
  coalesce(array_to_string({hits("lower(concat_ws(' ', subject, body))", sorted(V.SERVING_KEYWORDS))}, ','), '') as keywords from emails""")
oracle("f7_entropy", [], f"select doc_id, {even(entropy('t'), 4)} as entropy from (select doc_id, {basic('text')} as t from documents)")
oracle("f8_language", ["emails"], f"""select email_id, {language('t')} as detected_language from (
  select email_id, case when email_id % 9 = 4 then regexp_replace(body, '[A-Za-z]', '', 'g') else body end as t from emails)""")
oracle("f9_features", ["feats"], f"""select email_id, category, clean_email_text, coalesce(array_to_string(urls, ' | '), '') as extracted_urls, {FEATURES} from feats""")
oracle("f10_coerce", ["gapped"], f"select email_id, {repaired('urls')} as as_double, {TO_INT} as as_int from gapped")


# --- URLs -----------------------------------------------------------------------------

REFANG = (
    f"regexp_replace(replace(replace(regexp_replace(regexp_replace({strip('raw_url')}, '(?i)^hxxps://', 'https://'), "
    "'(?i)^hxxp://', 'http://'), '[.]', '.'), '(.)', '.'), '(?i)^(www\\.)', 'http://\\1')"
)
NETLOC = r"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
REFANG_PLAIN = (
    f"regexp_replace(replace(replace(replace(replace(trim({strip('raw_url')}, {q(V.URL_EDGE_CHARS)}), 'hxxps://', 'https://'), "
    "'hxxp://', 'http://'), '[.]', '.'), '(.)', '.'), '^(www\\.)', 'http://\\1')"
)
cte("refanged", ["url_rows"], f"select *, {REFANG} as normalized_url, lower(raw_url) as low from url_rows")
cte("domains", ["refanged"], f"select *, coalesce(nullif({NETLOC.format(x='normalized_url')}, ''), 'Unknown') as domain from refanged")


def scored(source: str, rules: list[tuple[str, str, str]], fallback: str) -> str:
    points = " + ".join(f"case when {t} then {p} else 0 end" for t, p, _ in rules)
    sentences = "list_filter([" + ", ".join(f"case when {t} then {s} end" for t, _, s in rules) + "], lambda r: r is not null)"
    return f"""select *, ({points})::int as score, coalesce(nullif(array_to_string({sentences}, ' | '), ''), {q(fallback)}) as reasons from {source}"""


def occurrences(x: str, piece: str) -> str:
    return f"(length({x}) - length(replace({x}, {q(piece)}, '')))"


FOUND = hits("low", V.URL_WORDS)
cte("weighted", ["domains"], scored("domains", [
    (f"regexp_matches(low, {q(V.DEFANGED)})", "40", q("Defanged or obfuscated URL pattern detected.")),
    (f"len({FOUND}) > 0", f"least(30, 10 * len({FOUND}))", f"'The URL contains suspicious words: ' || array_to_string({FOUND}, ', ')"),
    (f"len({hits('low', V.URL_LOOKALIKES)}) > 0", "25", q("A possible look-alike domain pattern was detected.")),
    ("contains(low, 'xn--')", "30", q("Punycode domain detected.")),
    (r"len(regexp_extract_all(domain, '\p{Nd}')) >= 3", "10", q("The domain contains several numeric characters.")),
    (occurrences("domain", "-") + " >= 3", "10", q("The domain contains an unusual number of hyphens.")),
    ("length(domain) > 40", "10", q("The domain name is unusually long.")),
    ("contains(normalized_url, '@')", "20", q("The URL contains an @ symbol, which can hide the real destination.")),
], "No major suspicious URL pattern was detected."))
cte("weighted_risk", ["weighted"], "select *, case when score >= 50 then 'High' when score >= 20 then 'Suspicious' else 'Low' end as risk from weighted")
IPV4 = r"regexp_matches({x}, '^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){{3}}$')"
cte("hosts", ["url_rows"], f"""select * exclude (h), split_part(regexp_extract(h, '([^@]*)$', 1), ':', 1) as domain from (
  select *, lower({NETLOC.format(x='normalized_url')}) as h from (select *, {REFANG_PLAIN} as normalized_url from url_rows))""")
FOUND2 = hits("lower(normalized_url)", V.URL_POINT_WORDS)
cte("pointed", ["hosts"], scored("hosts", [
    ("contains(lower(raw_url), 'hxxp') or contains(raw_url, '[.]') or contains(raw_url, '(.)')", "2", q("Defanged or suspicious-looking URL format detected")),
    ("starts_with(lower(normalized_url), 'http:')", "2", q("URL uses HTTP instead of HTTPS")),
    ("contains(normalized_url, '@')", "2", q("URL contains '@' symbol, which can hide the real domain")),
    (IPV4.format(x="domain"), "3", q("URL uses an IP address instead of a domain name")),
    ("contains(domain, 'xn--')", "2", q("Punycode domain detected, possible homoglyph attack")),
    (f"list_contains({words(V.SHORTENERS)}, domain)", "2", q("URL shortener detected")),
    (f"len({FOUND2}) > 0", f"least(3, len({FOUND2}))", f"'Suspicious URL keywords found: ' || array_to_string({FOUND2}[1:5], ', ')"),
    ("length(normalized_url) > 100", "1", q("URL is unusually long")),
    (occurrences("domain", ".") + " >= 3", "1", q("URL contains many subdomains")),
    (f"({entropy('domain')}) > 3.8", "1", q("Domain has high character randomness")),
], "No major URL risk indicators detected"))


def point_level(x: str) -> str:
    return f"case when {x} = 0 then 'Safe' when {x} <= 2 then 'Low' when {x} <= 5 then 'Suspicious' else 'High' end"


cte("pointed_risk", ["pointed"], f"select *, {point_level('score')} as risk from pointed")
oracle("u1_refang", ["refanged"], "select src, id, pos, normalized_url from refanged")
oracle("u2_domain", ["domains"], "select src, id, pos, domain from domains")
oracle("u3_weighted_score", ["weighted_risk"], "select src, id, pos, normalized_url, domain, risk, score, reasons from weighted_risk")
cte("mail_risk", ["emails", "weighted_risk"], """select e.email_id, count(w.id)::int as url_count,
  case max(case w.risk when 'High' then 3 when 'Suspicious' then 2 when 'Low' then 1 end) when 3 then 'High' when 2 then 'Suspicious' when 1 then 'Low' else 'None' end as highest_url_risk,
  coalesce(string_agg(w.risk || ':' || w.score, ',' order by w.pos), '') as scores
from emails e left join weighted_risk w on w.src = 'mail' and w.id = e.email_id group by e.email_id""")
oracle("u4_mail_report", ["mail_risk"], "select * from mail_risk")
oracle("u5_point_score", ["pointed_risk"], "select src, id, pos, normalized_url, domain, risk, score, reasons from pointed_risk")
cte("host_rows", ["refanged"], f"""select src, id, pos, lower({NETLOC.format(x='normalized_url')}) as host from refanged
union all select 'made', doc_id, 0::int, case doc_id % 4 when 0 then '10.0.' || (doc_id % 300) || '.7' when 1 then '2001:db8::' || lower(to_hex(doc_id))
  when 2 then ({words(V.SHORTENERS)})[(doc_id % 9 + 1)::int] else 'a.' || source || '.b.c.example.test' end from documents""")
oracle("u6_host_tests", ["host_rows"], rf"""select src, id, pos, host, ({IPV4.format(x='host')} or regexp_matches(host, '^2001:db8::[0-9a-f]{{1,4}}$')) as is_ip,
  list_contains({words(V.SHORTENERS)}, host) as is_shortener, {occurrences('host', '.')} >= 3 as many_subdomains from host_rows""")
oracle("u7_point_report", ["emails", "pointed_risk"], f"""select email_id, url_count, highest_url_score,
  case when url_count = 0 then 'None' else {point_level('highest_url_score')} end as highest_url_risk from (
  select e.email_id, count(w.id)::int as url_count, coalesce(max(w.score), 0)::int as highest_url_score
  from emails e left join pointed_risk w on w.src = 'mail' and w.id = e.email_id group by e.email_id)""")

# --- headers ------------------------------------------------------------------------------

ADDRESS = "lower(case when contains({x}, '<') then regexp_extract({x}, '<([^>]*)>', 1) else trim({x}) end)"
cte("parsed", ["mail_headers"], f"""select *, {ADDRESS.format(x='from_header')} as from_address, trim(regexp_extract(from_header, '^([^<]*)<', 1)) as from_display_name,
  {ADDRESS.format(x='reply_to_header')} as reply_to_address, {ADDRESS.format(x='return_path_header')} as return_path_address,
  split_part(from_address, '@', 2) as from_domain, split_part(reply_to_address, '@', 2) as reply_to_domain,
  split_part(return_path_address, '@', 2) as return_path_domain, lower(regexp_extract(message_id, '@([^>]+)', 1)) as message_id_domain
from mail_headers""")


def differs(x: str) -> str:
    return f"(from_domain <> '' and {x} <> '' and from_domain <> {x})::int"


AUTH = "|".join(V.AUTH_RESULTS)


def auth(m: str) -> str:
    return rf"coalesce(nullif(lower(regexp_extract(authentication_results, '(?i)\b{m}\s*=\s*({AUTH})', 1)), ''), 'unknown')"


cte("checked", ["parsed"], rf"""select *, {differs('reply_to_domain')} as from_replyto_mismatch, {differs('return_path_domain')} as from_returnpath_mismatch,
  {differs('message_id_domain')} as message_id_domain_mismatch,
  case when {auth('spf')} <> 'unknown' then {auth('spf')}
    else coalesce(nullif(lower(regexp_extract(received_spf, '(?i)\b({"|".join(V.RECEIVED_SPF_RESULTS)})\b', 1)), ''), 'unknown') end as spf,
  {auth('dkim')} as dkim, {auth('dmarc')} as dmarc from parsed""")
EXT = "lower(regexp_extract(filename, '[^.](\\.[^.]+)$', 1))"
INNER = "lower(regexp_extract(filename, '[^.](\\.[^.]+)\\.[^.]+$', 1))"


def within(x: str, items) -> str:
    return f"{x} in ({', '.join(q(i) for i in items)})"


cte("rated_parts", ["attachments"], f"""select *, {EXT} as extension, {within(INNER, V.DOUBLE_EXTENSION_INNER)} as doubled,
  case when {within('extension', V.EXECUTABLE_EXTENSIONS)} then 'Critical' when {within('extension', V.MACRO_EXTENSIONS)} then 'High'
    when {within('extension', V.ARCHIVE_EXTENSIONS)} then 'Medium' else 'Low' end as kind,
  case when doubled then 'Critical' else kind end as risk,
  concat_ws(' | ', case kind when 'Critical' then 'Executable or script attachment type detected.' when 'High' then 'Macro-enabled Microsoft Office attachment detected.'
    when 'Medium' then 'Archive attachment detected; contents were not opened.' end, case when doubled then 'Possible double-extension filename detected.' end) as warnings
from attachments""")
cte("part_sums", ["rated_parts"], f"""select email_id, count(*) as attachment_count,
  sum(case risk when 'Critical' then 3 when 'High' then 2 when 'Medium' then 1 else 0 end) as points,
  max({within('extension', V.EXECUTABLE_EXTENSIONS)}::int) as has_executable_attachment, max({within('extension', V.MACRO_EXTENSIONS)}::int) as has_macro_attachment
from rated_parts group by email_id""")
SPF_BAD = "spf in ('fail', 'softfail', 'permerror')"
SCORE = f"""from_replyto_mismatch + from_returnpath_mismatch + message_id_domain_mismatch + case when {SPF_BAD} then 2 else 0 end
  + case when dkim in ('fail', 'permerror') then 2 else 0 end + case when dmarc in ('fail', 'permerror') then 2 else 0 end + coalesce(points, 0)"""
LEVEL = "case when header_risk_score >= 6 then 'Critical' when header_risk_score >= 4 then 'High' when header_risk_score >= 2 then 'Medium' else 'Low' end"
oracle("h1_addresses", ["parsed", "emails"], """select p.email_id, from_address, from_display_name, reply_to_address, return_path_address,
  case when e.receiver is null then '' else '=' || e.receiver || ';' end || 'Team ' || e.source_dataset || '=' || e.sender as to_list
from parsed p join emails e on e.email_id = p.email_id""")
oracle("h2_domains", ["parsed"], "select email_id, from_domain, reply_to_domain, return_path_domain, message_id_domain from parsed")
oracle("h3_mismatches", ["checked"], "select email_id, from_replyto_mismatch, from_returnpath_mismatch, message_id_domain_mismatch from checked")
oracle("h4_authentication", ["checked"], "select email_id, spf, dkim, dmarc from checked")
oracle("h5_attachments", ["rated_parts"], """select email_id, att_no::int as att_no, case when filename = '' then 'unnamed_attachment' else filename end as filename,
  extension, risk, warnings, size_bytes from rated_parts""")
oracle("h6_header_risk", ["checked", "part_sums"], f"""select email_id, header_risk_score, {LEVEL} as header_risk, warnings from (
  select c.email_id, ({SCORE})::int as header_risk_score, concat_ws(' | ',
    case when from_replyto_mismatch = 1 then 'The From and Reply-To domains do not match.' end,
    case when from_returnpath_mismatch = 1 then 'The From and Return-Path domains do not match.' end,
    case when message_id_domain_mismatch = 1 then 'The Message-ID domain does not match the From domain.' end,
    case when {SPF_BAD} then 'SPF authentication result is ' || spf || '.' end,
    case when dkim in ('fail', 'permerror') then 'DKIM authentication result is ' || dkim || '.' end,
    case when dmarc in ('fail', 'permerror') then 'DMARC authentication result is ' || dmarc || '.' end,
    case when authentication_results = '' and received_spf = '' then 'No SPF, DKIM, or DMARC result was found in the visible headers.' end) as warnings
  from checked c left join part_sums p on p.email_id = c.email_id)""")
oracle("h7_security_features", ["checked", "part_sums"], """select c.email_id, from_replyto_mismatch, from_returnpath_mismatch, message_id_domain_mismatch,
  coalesce(attachment_count, 0)::bigint as attachment_count, coalesce(has_executable_attachment, 0)::int as has_executable_attachment,
  coalesce(has_macro_attachment, 0)::int as has_macro_attachment from checked c left join part_sums p on p.email_id = c.email_id""")
PATH = "'mail/' || email_id || case when email_id % 50 = 49 then '.txt' else '.eml' end"
ERROR = "case when email_id % 50 = 49 then 'not an .eml file' when email_id % 40 = 39 then 'empty file' end"
cte("mailbox", ["checked", "emails", "rated_parts"], f"""select c.*, e.subject, e.sender, e.body, {PATH.replace('email_id', 'c.email_id')} as path, {ERROR.replace('email_id', 'c.email_id')} as error,
  (r.email_id is not null)::int as attachment_count, case r.risk when 'Critical' then 3 when 'High' then 2 when 'Medium' then 1 else 0 end as points
from checked c join emails e on e.email_id = c.email_id left join rated_parts r on r.email_id = c.email_id and r.att_no = 1""")


def good(x: str, name: str) -> str:
    return f"case when error is null then {x} end as {name}"


oracle("s7_eml_scan", ["mailbox"], "select path, error, " + ", ".join([
    good(strip("subject"), "subject"), *[good(x, x) for x in ("from_address", "from_display_name")],
    good("sender || ',' || sender", "to_addresses"),
    *[good(x, x) for x in ("from_domain", "reply_to_domain", "spf", "dkim", "dmarc", "attachment_count", "header_risk_score")],
    good(LEVEL, "header_risk"),
]) + f" from (select *, ({SCORE})::int as header_risk_score from mailbox)")
cte("mail_bodies", ["mailbox"], f"""select path, error, case when email_id % 3 = 0 then '' else coalesce(array_to_string({lines('body')}, chr(10)), '') end as plain,
  case when email_id % 3 = 1 then '' else 'Mail ' || email_id || chr(10) || 'two & three' end as rich from mailbox""")
oracle("h8_body_choice", ["mail_bodies"], """select path, case when error is not null then '' when plain <> '' then plain else rich end as body,
  case when error is not null then 'unavailable' when plain <> '' then 'text/plain' when rich <> '' then 'text/html converted to text' else 'unavailable' end as body_source,
  error is null and rich <> '' as has_html_body from mail_bodies""")
oracle("h9_received_count", ["mailbox"], "select path, (email_id % 4)::int as received_count from mailbox where error is null")

# --- filters ------------------------------------------------------------------------------

oracle("r1_drop_invalid", ["master"], f"select email_id, source_dataset, category from master where not {blank('body')} and not {blank('email_text')} and email_id % 12 <> 0")
oracle("r2_drop_service_mail", ["master"], """select email_id, source_dataset from (
  select *, case when email_id % 3 = 0 then subject || ' Folder INTERNAL data' else subject end as s from master)
where not (source_dataset = 'Nazario' and contains(lower(s), 'folder internal data'))""")
oracle("r3_drop_both_blank", ["filled"], f"select email_id from filled where not ({blank('subject')} and {blank('body')})")
cte("repeated", [], f"select doc_id, cast(substr(source, 4) as bigint) % 4 as corpus_rank, source, {basic('text')} as email_text from documents")
oracle("r4_keep_first", ["repeated"], """select doc_id, corpus_rank, source from (
  select *, row_number() over (partition by email_text order by corpus_rank, doc_id) as rn from repeated) where rn = 1""")
oracle("r5_running_id", ["repeated"], """select row_number() over (order by corpus_rank nulls first, doc_id) as email_id, doc_id, corpus_rank
from (select doc_id, case when doc_id % 9 <> 0 then corpus_rank end as corpus_rank from repeated)""")
oracle("r6_code_mixed_only", ["feats"], f"select email_id, detected_language from feats where {within('detected_language', V.CODE_MIXED)}")
oracle("r7_duplicate_counts", [], """with t as (select text as email_text, split_part(text, chr(10), 1) as subject, substr(text, length(split_part(text, chr(10), 1)) + 2) as body from documents)
select 'email_text' as columns, count(*) - count(distinct email_text) as duplicates from t
union all select 'subject+body', count(*) - count(distinct (subject, body)) from t
union all select 'body', count(*) - count(distinct body) from t
union all select 'subject', count(*) - count(distinct subject) from t""")
oracle("r8_with_category", ["emails"], "select email_id, category from emails where quality is null or quality <> 0")

# --- joins ------------------------------------------------------------------------------------

oracle("j1_union_aligned", ["version_two"], "select * from version_two")
oracle("j2_label_lookup", ["predictions"], """select email_id, case when c = 'Legitimate' then 'Safe' when c = 'Spam' then 'Medium' when c = 'Traditional_Phishing' then 'High'
    when c in ('Business_Email_Compromise', 'AI_Generated_Phishing') then 'Critical' else 'High' end as risk,
  case c when 'Legitimate' then 0 when 'Spam' then 1 when 'Traditional_Phishing' then 2 when 'Business_Email_Compromise' then 3 when 'AI_Generated_Phishing' then 4 end::int as label
from (select email_id, case when email_id % 6 = 0 then 'Other' else category end as c from predictions)""")
oracle("j3_fuse_branches", ["mail_vectors", "mail_headers"], """select email_id, unnest(range(0, len(f)))::int as pos, unnest(f) as value from (
  select v.email_id, list_concat(list_concat(list_transform(v.embedding, lambda x: x::double), list_transform(v.w, lambda x: x / list_sum(v.w))), [length(h.from_header)::double, length(h.message_id)::double]) as f
  from (select *, list_transform(embedding[1:5], lambda x: (1 + floor(abs(x::float) * 1000::float))::double) as w from mail_vectors) v
  join mail_headers h on h.email_id = v.email_id)""")
oracle("j4_alignment", ["predictions"], """select count(*) filter (l.email_id is not null and r.email_id is not null and l.category = r.prediction) as matching,
  count(*) filter (l.email_id is not null and r.email_id is not null and l.category <> r.prediction) as different,
  count(*) filter (l.email_id is null) as missing_left, count(*) filter (r.email_id is null) as missing_right
from (select * from predictions where email_id % 10 <> 0) l full join (select * from predictions where email_id % 15 <> 0) r on l.email_id = r.email_id""")
oracle("j5_split_summary", ["split_table"], "select * from split_table")
oracle("j6_remainder", ["predictions", "sampled"], "select email_id, category from predictions where email_id not in (select email_id from sampled)")

# --- sampling -----------------------------------------------------------------------------------

oracle("t1_stratified_split", ["splits"], "select email_id, category, split from splits")
oracle("t2_simple_sample", ["sampled"], "select * from sampled")
oracle("t3_stratified_sample", ["predictions"], f"""with r as (select email_id, prediction as category, {KEY} as k,
    row_number() over (partition by prediction order by {KEY}, email_id) as rn, count(*) over (partition by prediction) as nc, count(*) over () as n from predictions),
m as (select *, rn <= greatest(1, least(333, n) * nc // n) as chosen from r),
o as (select *, row_number() over (order by chosen desc, k, email_id) as pos from m)
select email_id, category from o where pos <= 333""")
oracle("t4_generate", ["code_mixed"], "select * from code_mixed")
oracle("t5_balanced_weight", ["predictions"], f"""select prediction, n, {even('sum(n) over ()::double / (count(*) over () * n)', 9)} as weight
from (select prediction, count(*) as n from predictions group by 1)""")

# --- profiles -----------------------------------------------------------------------------------

oracle("a1_class_distribution", ["predictions"], f"""select prediction, n as count, {even('n::double / sum(n) over () * 100', 2)} as percentage
from (select prediction, count(*) as n from predictions group by 1)""")
oracle("a2_value_counts", ["feats", "predictions", "feedback"], """select 'detected_language' as column, detected_language as value, count(*) as count from feats group by 2
union all select 'attack_type', attack_type, count(*) from predictions group by 2
union all select 'feedback_status', feedback_status, count(*) from feedback group by 2
union all select 'correct_category', correct_category, count(*) from feedback group by 2""")
oracle("a3_null_profile", ["emails"], "select * from (" + " union all ".join(
    f"select '{x}' as column, count(*) filter ({x} is null) as nulls from emails"
    for x in ("email_id", "source_dataset", "sender", "receiver", "subject", "body", "category", "quality", "toxic")
) + ") where nulls > 0")
oracle("a4_describe", ["feats"], " union all ".join(f"""select category, '{x}' as column, count({x}) as count, {even(f'avg({x})', 2)} as mean,
  {even(f'stddev_samp({x})', 2)} as std, min({x})::double as min, {even(f'quantile_cont({x}::double, 0.25)', 2)} as q25, {even(f'quantile_cont({x}::double, 0.5)', 2)} as q50,
  {even(f'quantile_cont({x}::double, 0.75)', 2)} as q75, max({x})::double as max from feats group by category""" for x in ("text_char_count", "text_word_count")))
PROFILED = [
    "url_count_extracted", "has_url", "has_defanged_url", "text_char_count", "text_word_count",
    "suspicious_keyword_count", "email_entropy",
]
oracle("a5_mean_features", ["feats"], "select category, " + ", ".join(f"{even(f'avg({x})', 2)} as {x}" for x in PROFILED) + " from feats group by category")
oracle("a6_box_plot", ["feats"], """, b as (select category, quantile_cont(text_word_count::double, 0.25) as q1, quantile_cont(text_word_count::double, 0.5) as median,
  quantile_cont(text_word_count::double, 0.75) as q3 from feats group by category),
w as (select b.*, f.text_word_count::double as x, x >= q1 - 1.5 * (q3 - q1) and x <= q3 + 1.5 * (q3 - q1) as inside from feats f join b on b.category = f.category)
select category, q1, median, q3, min(x) filter (inside) as whisker_low, max(x) filter (inside) as whisker_high, count(*) filter (not inside) as outliers
from w group by category, q1, median, q3""")
oracle("a7_split_share", ["split_table"], "select category, " + ", ".join(f"{even(f'{s}::double / total * 100', 2)} as {s}" for s in ("train", "validation", "test")) + " from split_table")
oracle("a8_compare_versions", ["feats", "version_two"], " union all ".join(
    f"select '{n}' as version, count(*) as total_rows, count(distinct category) as categories, count(distinct detected_language) as languages from {t}"
    for n, t in (("v1", "feats"), ("v2", "version_two"))
))
oracle("a9_label_map", ["master"], "select distinct category, label from master")

# --- metrics -----------------------------------------------------------------------------------


def class_table(source: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""select {group}class, support, hits, case when predicted = 0 then 0 else hits::double / predicted end as precision,
  case when support = 0 then 0 else hits::double / support end as recall,
  case when support + predicted = 0 then 0 else 2.0::double * hits / (support + predicted) end as f1
from (select {'m.' + by + ', ' if by else ''}k.class, count(*) filter (s.category = k.class) as support, count(*) filter (s.prediction = k.class) as predicted,
    count(*) filter (s.category = k.class and s.prediction = k.class) as hits
  from (select unnest({words(V.CLASSES_SORTED)}) as class) k {f'cross join (select distinct {by} from {source}) m' if by else ''} join {source} s on {f's.{by} = m.{by}' if by else 'true'} group by all)"""


cte("scores", ["predictions"], class_table("predictions"))
MEASURES = ("precision", "recall", "f1")
REPORT = (
    "select class, " + ", ".join(f"{even(m, 4)} as {m}" for m in MEASURES) + ", support from scores union all select 'accuracy', "
    + ", ".join([even("sum(hits)::double / sum(support)", 4)] * 3) + ", sum(support)::bigint from scores union all select 'macro avg', "
    + ", ".join(even(f"avg({m})", 4) for m in MEASURES) + ", sum(support)::bigint from scores union all select 'weighted avg', "
    + ", ".join(even(f"sum({m} * support)::double / sum(support)", 4) for m in MEASURES) + ", sum(support)::bigint from scores"
)
oracle("m1_accuracy", ["predictions"], f"select count(*) as rows, {even('avg((category = prediction)::int::double)', 9)} as accuracy from predictions")
oracle("m2_confusion_matrix", ["predictions"], "select category as actual, " + ", ".join(f"count(*) filter (prediction = {q(x)}) as {q(x).replace(chr(39), chr(34))}" for x in V.CLASSES_SORTED) + " from predictions group by 1")
oracle("m3_report", ["scores"], REPORT)
oracle("m4_macro_f1", ["scores"], f"select {even('avg(f1)', 9)} as macro_f1 from scores")
oracle("m5_robustness", ["predictions"], f"""select attack_type, count(*) as rows, count(*) filter (category = prediction) as correct_rows,
  {even('avg((category = prediction)::int::double)', 4)} as accuracy, {even('avg(' + even('confidence', 4) + ')', 4)} as mean_confidence from predictions group by 1""")
cte("attack_scores", ["predictions"], class_table("predictions", "attack_type"))
oracle("m4_summary_by_attack", ["attack_scores"], f"""select attack_type, sum(support)::bigint as rows,
  {even('sum(hits)::double / sum(support) * 100', 2)} as accuracy, {even('avg(f1)', 3)} as macro_f1 from attack_scores group by 1""")
cte("model_rows", ["predictions"], """select 'fusion' as model, category, prediction from predictions union all select 'majority', category, 'Legitimate' from predictions
union all select 'by_parity', category, case when email_id % 2 = 0 then category else 'Spam' end from predictions""")
cte("model_scores", ["model_rows"], class_table("model_rows", "model"))
oracle("m6_compare_models", ["model_scores"], f"""select *, row_number() over (order by accuracy desc, model)::int as rank from (
  select model, {even('sum(hits)::double / sum(support) * 100', 2)} as accuracy, {even('avg(f1)', 3)} as macro_f1 from model_scores group by model)""")
oracle("m7_feedback_kpis", ["feedback"], """select count(*) as total, count(*) filter (lower(feedback_status) = 'correct') as correct,
  count(*) filter (lower(feedback_status) = 'wrong') as wrong from feedback""")
oracle("s9_report_sink", ["scores", "predictions"], f""", rep as ({REPORT})
select 'report' as section, class as name, unnest(['precision', 'recall', 'f1', 'support']) as measure, unnest([precision, recall, f1, support::double]) as value from rep
union all select 'matrix', category, prediction, count(*)::double from predictions group by 2, 3""")

# --- rankings -----------------------------------------------------------------------------------

oracle("k1_probability_ranking", ["probs"], f"""select email_id, row_number() over (partition by email_id order by v desc, i)::int as rank, replace(class, '_', ' ') as class, {even('v * 100', 2)} as percent
from (select email_id, unnest(p) as v, unnest(range(0, 5)) as i, unnest({words(V.CLASSES_SORTED)}) as class from probs)""")
oracle("k2_arg_max", ["probs"], f"select email_id, ({words(V.CLASSES_SORTED)})[list_position(p, list_max(p))] as prediction, {even('list_max(p)', 9)} as confidence from probs")
cte("components", [], "select vec_id as email_id, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as value from embeddings")
oracle("k4_top_drops", ["components"], """select email_id, rank::int as rank, 'w' || i as name, value from (
  select *, row_number() over (partition by email_id order by value desc, i) as rank from components where value > 0) where rank <= 5""")
oracle("k5_top_absolute", ["components"], """select email_id, rank::int as rank, 'w' || i as name, value from (
  select *, row_number() over (partition by email_id order by abs(value) desc, i) as rank from components) where rank <= 25""")
oracle("k6_newest_first", ["feedback"], "select id, feedback_status, prediction_confidence from feedback")
oracle("k7_preview", ["feats"], f"select email_id, category, detected_language, subject, body from feats where {within('detected_language', V.CODE_MIXED)} order by email_id limit 10")

# --- encoders -----------------------------------------------------------------------------------

oracle("e1_standard_scaler", ["feats"], "select email_id, " + ", ".join(
    even(f"({x} - avg({x}) over ()) / case when stddev_pop({x}) over () = 0 then 1 else stddev_pop({x}) over () end", 6) + f" as {x}" for x in V.NUMERIC_FEATURES
) + " from feats")
oracle("e2_one_hot", ["feats"], """select f.email_id, l.level, (f.detected_language = l.level)::int as flag
from feats f join (select distinct detected_language as level from feats where email_id % 10 <> 2) l on true""")
cte("kept", ["feats"], rf"""select email_id, list_filter(regexp_extract_all(clean_email_text, '[\p{{L}}\p{{N}}_]{{2,}}'),
  lambda w: not list_contains({words(V.OCCLUSION_STOP_WORDS)}, lower(w))).list_transform(lambda w: lower(w)) as ws from feats""")
cte("word_lists", ["kept"], "select email_id, list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as g from kept")


def vocabulary(source: str, size: int) -> str:
    return f"""select gram, count(distinct email_id) as documents, count(*) as occurrences from (select email_id, unnest(g) as gram from {source})
group by gram order by occurrences desc, gram limit {size}"""


for name in ("e3_word_grams", "e3_frequent_word_grams"):
    oracle(name, ["word_lists"], vocabulary("word_lists", 50000))
cte("padded", ["feats"], f"select email_id, ' ' || unnest(list_filter(regexp_split_to_array(clean_email_text, '[{V.WS}]+'), lambda w: w <> '')) || ' ' as w from feats")
cte("char_lists", ["padded"], """select email_id, list_concat(
  case when length(w) <= 3 then [w] else list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) end, list_concat(
  case when length(w) < 4 then [] else list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) end,
  case when length(w) < 5 then [] else list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5)) end)) as g from padded""")
oracle("e4_char_grams", ["char_lists"], vocabulary("char_lists", 100000))
oracle("e5_label_ids", ["predictions"], "select email_id, category, (dense_rank() over (order by category) - 1)::int as label_id from predictions")
oracle("e6_masked_mean", [], f"""select email_id, i::int as pos, {even('coalesce(avg(x) filter (m), 0)', 6)} as value from (
  select vec_id % 50 as email_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x, vec_id % 3 <> 0 as m from embeddings) group by 1, 2""")
cte("vector_parts", [], "select vec_id, unnest(range(0, len(embedding)))::int as pos, unnest(embedding)::double as x from embeddings")
oracle("e7_fusion_scaler", ["vector_parts"], f"""select vec_id, pos, {even('(x - avg(x) over (partition by pos)) / stddev_pop(x) over (partition by pos)', 6)} + 0.0::double as value
from vector_parts""")
oracle("l6_width_check", [], "select vec_id, len(embedding)::int as width from embeddings")

# --- reasons ------------------------------------------------------------------------------------


def percent(x: str) -> str:
    return f"printf('%.2f', {even(f'{x} * 100.0', 2)})"


CLOSING = "case prediction " + " ".join(f"when {q(k)} then {q(s)}" for k, s in SERVICE_SENTENCES.items()) + " end"
oracle("x1_service_reasons", ["judged_serving", "mail_risk"], f"""select j.email_id, concat_ws(' | ',
  'The final hybrid model predicted ''' || replace(prediction, '_', ' ') || ''' with ' || {percent('confidence')} || '% confidence.',
  'The XGBoost structured branch predicted ''' || replace(branch_prediction, '_', ' ') || ''' with ' || {percent('branch_confidence')} || '% confidence.',
  case when suspicious_keyword_count > 0 then 'The email contains ' || suspicious_keyword_count || ' suspicious phishing-related keyword type(s).' end,
  case when has_url = 1 then 'The email contains ' || url_count_extracted || ' URL(s).' end,
  case when has_defanged_url = 1 then 'The email contains an obfuscated or defanged URL such as hxxp or [.]' end,
  case when highest_url_risk in ('Suspicious', 'High') then 'The URL-analysis component identified a ' || highest_url_risk || ' URL risk level.' end,
  case when detected_language not in ('English', 'Unknown') then 'The email contains multilingual or code-mixed text: ' || detected_language || '.' end,
  case when email_entropy > 4.5 then 'The email has relatively high text entropy, which may indicate unusual or obfuscated content.' end,
  {CLOSING}) as reasons from judged_serving j join mail_risk m on m.email_id = j.email_id""")
oracle("x2_report_reasons", ["judged"], f"""select email_id, concat_ws(' | ',
  'Final hybrid model predicted ''' || prediction || ''' with ' || {percent('confidence')} || '% confidence.',
  'The XGBoost structured branch predicted ''' || branch_prediction || ''' with ' || {percent('branch_confidence')} || '% confidence.',
  case when has_url = 1 then 'The email contains one or more URLs.' end,
  case when has_defanged_url = 1 then 'The email contains an obfuscated or defanged URL pattern such as hxxp or [.]' end,
  case when suspicious_keyword_count > 0 then 'The email contains ' || suspicious_keyword_count || ' suspicious phishing-related keyword(s).' end,
  case when detected_language <> 'English' then 'The email contains multilingual or code-mixed text: ' || detected_language || '.' end,
  case when email_entropy > 4.5 then 'The email has relatively high entropy, which may indicate unusual or obfuscated text.' end,
  case when prediction = 'Spam' then 'The model identified the email as spam-like promotional or unwanted content.'
    when prediction = 'Legitimate' then 'The model did not find enough strong phishing indicators to classify it as phishing.'
    else 'The predicted class belongs to a high-risk phishing-related category.' end) as reasons from judged""")
oracle("x3_candidates", ["feats"], rf"""select email_id, (row_number() over (partition by email_id order by first) - 1)::int as pos, word from (
  select email_id, word, first, row_number() over (partition by email_id order by first) as rn from (
    select email_id, word, min(i) as first from (select email_id, unnest(t) as word, unnest(range(0, len(t))) as i
      from (select email_id, regexp_extract_all(clean_email_text, '[A-Za-z0-9\x{{0d80}}-\x{{0dff}}\x{{0b80}}-\x{{0bff}}]+') as t from feats))
    where length(word) >= 3 and not list_contains({words(V.OCCLUSION_STOP_WORDS)}, lower(word)) group by 1, 2)) where rn <= 20""")

# --- feedback and streams -------------------------------------------------------------------------

oracle("b1_validate", ["verdicts"], f"select id, feedback_status, correct_category, {REJECTED} as rejected from verdicts")
oracle("b2_enrich", ["feedback", "judged"], f"""select v.id, v.email_id, v.feedback_status, v.correct_category, j.prediction as predicted_category,
  j.confidence as prediction_confidence, j.branch_prediction as xgboost_prediction, j.branch_confidence as xgboost_confidence, j.detected_language,
  j.url_count_extracted, j.has_url, j.has_defanged_url, j.suspicious_keyword_count, j.email_entropy,
  case when v.feedback_status not in ('Correct', 'Wrong') or v.feedback_status is null then 'status must be Correct or Wrong'
    when v.correct_category not in ({', '.join(q(x) for x in V.CLASSES)}) then 'unknown category' when v.id % 13 = 0 then 'empty e-mail'
    when j.email_id is null then 'unknown e-mail' end as rejected
from (select *, id % (select count(*) + 7 from documents) as email_id from feedback) v left join judged j on j.email_id = v.email_id""")
oracle("b3_export", ["feedback"], "select id, feedback_status, correct_category, coalesce(detected_language, '') as detected_language from feedback")
oracle("b4_training_candidates", ["enriched"], "select clean_email_text, arg_max(coalesce(correct_category, predicted_category), id) as category from enriched group by 1")
cte("stream_mail", [], "select doc_id as email_id, source as subject, text as body from documents")
feature_cte("stream_feats", "stream_mail", V.TRAINING_URL, V.TRAINING_KEYWORDS)
oracle("w1_feature_stream", ["stream_feats"], f"select email_id, clean_email_text, {FEATURES} from stream_feats")
oracle("w2_feedback_rates", [], """select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, strftime(w + interval 1 hour, '%Y-%m-%d %H:%M:%S') as window_end, event_type, count(*) as n
from (select distinct on (event_id) event_id, date_trunc('hour', ts) as w, event_type from events)
group by w, event_type""")

# --- models: what must hold for every row, next to facts that SQL knows by itself ------------------


def all_true(*names: str) -> str:
    return ", ".join(f"true as {n}" for n in names)


SOUND = all_true("class_known", "sums_to_one", "is_winner", "confidence_fits", "learned")
for name in ("l1_logistic_regression", "l1_logistic_regression_char", "l2_random_forest", "l3_boosted_trees", "l4_fusion_network"):
    oracle(name, ["splits"], f"select email_id, split, category, {SOUND} from splits where split <> 'train'")
oracle("l5_hybrid_scoring", ["feats_serving"], f"""select email_id, detected_language, url_count_extracted::bigint as url_count,
  {all_true("risk_fits", "is_winner", "sums_to_one", "branch_known", "has_reasons")} from feats_serving""")
oracle("s8_model_store", ["splits"], """select model, email_id, true as same
from splits, (values ('hybrid'), ('boosted'), ('text')) m(model)""")
oracle("m5_model_robustness", ["predictions"], f"""select attack_type, count(*) as rows, {all_true("correct_within_rows", "accuracy_fits")}
from predictions group by attack_type""")
oracle("m5_robustness_rows", ["predictions"], f"""select email_id, attack_type, category,
  {all_true("class_known", "flag_fits", "confidence_fits")} from predictions""")
oracle("k3_top_importances", [], f"select unnest(range(1, 11))::int as rank, {all_true('feature_known', 'in_order')}")
cte("text_tokens", ["feats"], """select email_id, unnest(t) as w, unnest(range(0, len(t))) as i
  from (select email_id, list_filter(regexp_split_to_array(clean_email_text, '[ ]+'), lambda w: w <> '') as t from feats)""")
oracle("e6_cooccurrences", ["text_tokens"], """select least(a.w, b.w) as word, greatest(a.w, b.w) as context, count(*) as n
  from text_tokens a join text_tokens b on b.email_id = a.email_id and b.i > a.i and b.i <= a.i + 5 group by 1, 2 having count(*) >= 50""")
oracle("e6_text_vectors", ["feats", "text_tokens"], """select email_id, 64::int as width, true as finite,
  (select count(distinct t.w) from text_tokens t where t.email_id = f.email_id and t.w in (select w from text_tokens group by w having count(*) >= 5)) as known_words
  from feats f""")
oracle("x3_occlusion", ["feats"], f"""select email_id,
  {all_true("class_known", "at_most_five", "words_known", "in_order", "all_positive")} from feats""")
oracle("x4_word_surrogate", ["emails"], f"""select email_id,
  {all_true("ranks_gapless", "at_most_ten", "terms_distinct", "effects_fit", "class_known")}, 100::bigint as samples from emails""")
oracle("x5_structured_attribution", ["feats"], f"select email_id, 10::bigint as features, {all_true('adds_up', 'class_known', 'any_effect')} from feats")
oracle("x6_importances", [], f"""select unnest([{', '.join(q(n) for n in [*V.NUMERIC_FEATURES, *V.CATEGORICAL_FEATURES])}]) as feature,
  {all_true("share", "shares_sum_to_one")}""")
oracle("x7_explanation_table", ["feats", "predictions"], f"""select f.email_id, p.attack_type, f.category as actual_class,
  {', '.join('f.' + n for n in V.NUMERIC_FEATURES)}, f.detected_language, {all_true("reasons_fit", "flag_fits", "has_occlusion")}
from feats f join predictions p on p.email_id = f.email_id""")
oracle("w1_score_stream", [], f"""select doc_id as email_id,
  {all_true("same_prediction", "same_confidence", "same_branch_prediction", "same_branch_confidence")} from documents""")
