"""Mail tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailsieve.session import spread

TABLES = ["documents", "pages", "labels", "embeddings", "events", "conversations", "benchmark"]

EMAILS = """
select email_id, source_dataset, sender, receiver, subject,
  case k when 0 then rest
    when 1 then concat(rest, ' Claim the prize <b>now</b>: click ', url, '.')
    when 2 then case when alt
        then concat(rest, ' ඔබේ ගිණුම verify කරන්න hxxps://bank', cast(email_id % 9 as string), '[.]test/login')
        else concat(rest, ' உங்கள் கணக்கு update hxxp://pay-a-b-c', cast(email_id % 9 as string), '[.]test/reset') end
    when 3 then concat(rest, ' Urgent invoice: wire the payment, write to ceo', cast(email_id % 5 as string), '@corp.example.test')
    else concat(rest, ' Kindly confirm your account at www.acc0unt-help.test/u?id=', cast(email_id as string)) end as body,
  case k when 0 then 'Legitimate' when 1 then 'Spam' when 2 then 'Traditional_Phishing'
         when 3 then 'Business_Email_Compromise' else 'AI_Generated_Phishing' end as category,
  quality, toxic
from (
  select d.doc_id as email_id, d.source as source_dataset,
    concat('u', cast(d.doc_id % 97 as string), '@mail', cast(d.doc_id % 7 as string), '.example.test') as sender,
    case when d.doc_id % 11 = 0 then null else concat('r', cast(d.doc_id % 13 as string), '@in.example.test') end as receiver,
    d.subject, substr(d.text, length(d.subject) + 2) as rest,
    d.doc_id % 5 as k, (d.doc_id % 10) >= 5 as alt, p.url, l.quality, l.toxic
  from (
    select doc_id, source, text, split_part(text, chr(10), 1) as subject,
      doc_id % (select count(*) from {pages}) as page_key
    from {documents}) d
  left join {pages} p on p.page_id = d.page_key
  left join {labels} l on l.doc_id = d.doc_id)
"""

MAIL_HEADERS = """
select doc_id as email_id,
  concat('Desk ', source, ' <help@', source, '.example.test>') as from_header,
  case when doc_id % 4 = 0 then concat('<x@other', cast(doc_id % 3 as string), '.example.test>')
       when doc_id % 4 = 1 then concat('help@', upper(source), '.example.test') else '' end as reply_to_header,
  case when doc_id % 6 = 0 then '<bounce@relay.example.test>' else '' end as return_path_header,
  case when doc_id % 8 = 0 then concat('<', cast(doc_id as string), '@mx.example.test>')
       else concat('<', cast(doc_id as string), '@', source, '.example.test>') end as message_id,
  case when doc_id % 3 = 0 then 'mx; spf=pass; dkim = FAIL; dmarc=permerror'
       when doc_id % 3 = 1 then 'mx; SPF=softfail; dkim=pass' else '' end as authentication_results,
  case when doc_id % 9 = 2 then 'Fail (sender not permitted)' else '' end as received_spf
from {documents}
"""

ATTACHMENTS = """
select doc_id as email_id, 1 as att_no,
  case doc_id % 7 when 0 then 'invoice.pdf.exe' when 1 then 'sheet.XLSM' when 2 then 'pack.zip' when 3 then 'photo.jpg'
       when 4 then 'notes.pdf.zip' when 5 then 'run.ps1' else '' end as filename,
  n_chars as size_bytes
from {documents} where doc_id % 2 = 0
union all
select doc_id as email_id, 2 as att_no, 'readme.txt' as filename, n_chars as size_bytes from {documents} where doc_id % 6 = 0
"""

PREDICTIONS = """
select doc_id as email_id, concat('attack', cast(doc_id % 8 as string)) as attack_type,
  case doc_id % 5 when 0 then 'Legitimate' when 1 then 'Spam' when 2 then 'Traditional_Phishing'
       when 3 then 'Business_Email_Compromise' else 'AI_Generated_Phishing' end as category,
  case when doc_id % 7 = 0 then 'Spam' when doc_id % 5 = 3 and doc_id % 2 = 0 then 'Legitimate'
       else case doc_id % 5 when 0 then 'Legitimate' when 1 then 'Spam' when 2 then 'Traditional_Phishing'
       when 3 then 'Traditional_Phishing' else 'AI_Generated_Phishing' end end as prediction,
  cast(50 + doc_id % 50 as double) / 100 as confidence
from {documents}
"""

FEEDBACK = """
select event_id as id, ts,
  case event_type when 'click' then 'Correct' when 'view' then 'Wrong' when 'signup' then 'correct' when 'purchase' then 'WRONG' else 'Maybe' end as feedback_status,
  case user_id % 6 when 0 then 'Legitimate' when 1 then 'Spam' when 2 then 'Traditional_Phishing'
       when 3 then 'Business_Email_Compromise' when 4 then 'AI_Generated_Phishing' else 'Other' end as correct_category,
  case event_id % 4 when 0 then 'English' when 1 then 'CodeMixed_Sinhala_English' when 2 then 'CodeMixed_Tamil_English' else null end as detected_language,
  value as prediction_confidence
from {events}
"""

# Three class probabilities that sum to one, from the first components of a vector.
CLASS_PROBABILITIES = """
select email_id, array(p0 / s, p1 / s, p2 / s, p3 / s, p4 / s) as probabilities from (
  select *, p0 + p1 + p2 + p3 + p4 as s from (
    select vec_id as email_id,
      1D + floor(abs(embedding[0]) * 1000) as p0, 1D + floor(abs(embedding[1]) * 1000) as p1,
      1D + floor(abs(embedding[2]) * 1000) as p2, 1D + floor(abs(embedding[3]) * 1000) as p3,
      1D + floor(abs(embedding[4]) * 1000) as p4
    from {embeddings}))
"""

# Whole messages in transfer format: encoded subject, two to four parts, hops.
RAW_MAIL = """
select concat('mail/', cast(email_id as string), case when email_id % 50 = 49 then '.txt' else '.eml' end) as path,
  cast(length(content) as long) as length, content
from (
  select email_id, case when email_id % 40 = 39 then encode('', 'UTF-8') else encode(concat(
    array_join(transform(sequence(1, 4), i -> case when i <= email_id % 4
      then concat('Received: from hop', cast(i as string), '.example.test\\r\\n') else '' end), ''),
    'From: ', from_header, '\\r\\n',
    case when reply_to_header <> '' then concat('Reply-To: ', reply_to_header, '\\r\\n') else '' end,
    case when return_path_header <> '' then concat('Return-Path: ', return_path_header, '\\r\\n') else '' end,
    'To: One <', sender, '>, ', upper(sender), '\\r\\n',
    'Message-ID: ', message_id, '\\r\\n',
    case when authentication_results <> '' then concat('Authentication-Results: ', authentication_results, '\\r\\n') else '' end,
    case when received_spf <> '' then concat('Received-SPF: ', received_spf, '\\r\\n') else '' end,
    'Subject: =?utf-8?B?', replace(base64(encode(subject, 'UTF-8')), '\\r\\n', ''), '?=\\r\\n',
    'MIME-Version: 1.0\\r\\nContent-Type: multipart/mixed; boundary="cut"\\r\\n\\r\\n',
    case when email_id % 3 = 0 then '' else concat(
      '--cut\\r\\nContent-Type: text/plain; charset="utf-8"\\r\\nContent-Transfer-Encoding: base64\\r\\n\\r\\n',
      base64(encode(body, 'UTF-8')), '\\r\\n') end,
    case when email_id % 3 = 1 then '' else concat(
      '--cut\\r\\nContent-Type: text/html; charset="utf-8"\\r\\nContent-Transfer-Encoding: base64\\r\\n\\r\\n',
      base64(encode(concat('<html><style>p {{}}</style><p>Mail ', cast(email_id as string), '</p><div>two &amp; three</div></html>'), 'UTF-8')), '\\r\\n') end,
    case when filename is null then '' else concat(
      '--cut\\r\\nContent-Type: application/octet-stream\\r\\nContent-Disposition: attachment',
      case when filename <> '' then concat('; filename="', filename, '"') else '' end,
      '\\r\\nContent-Transfer-Encoding: base64\\r\\n\\r\\n', base64(encode(repeat('x', cast(email_id % 100 as int)), 'UTF-8')), '\\r\\n') end,
    '--cut--\\r\\n'), 'UTF-8') end as content
  from (
    select e.*, h.from_header, h.reply_to_header, h.return_path_header, h.message_id, h.authentication_results,
      h.received_spf, a.filename
    from ({emails}) e join ({mail_headers}) h on h.email_id = e.email_id
    left join (select * from ({attachments}) where att_no = 1) a on a.email_id = e.email_id))
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a view text; only the tables it names are opened, and only work on texts is spread."""
    used = {}
    if "{emails}" in sql:
        sql = sql.replace("{emails}", EMAILS).replace("{mail_headers}", MAIL_HEADERS).replace("{attachments}", ATTACHMENTS)
    for name in TABLES:
        if "{" + name + "}" in sql:
            df = table(spark, sf_dir, name)
            used[name] = spread(df, "doc_id") if name == "documents" and "text" in sql else df
    return spark.sql(sql, **used)


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EMAILS)
