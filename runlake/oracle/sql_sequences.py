"""Oracle SQL for the sequence family."""

from runlake.functions.sequences import CODON_TABLE
from runlake.oracle.sql import oracle

_CODON_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CODON_TABLE.items()) + "}"


def _translate(seq: str, offset: int) -> str:
    return f"""array_to_string(list_transform(range({offset}, length({seq}) - 2, 3),
           lambda i: coalesce({_CODON_MAP}[substr({seq}, i + 1, 3)], 'X')), '')"""


oracle("translate_sequences", f"SELECT seq_id, {_translate('seq', 1)} AS protein FROM v_seq")

oracle("translate_upper", f"""
WITH s AS (SELECT doc_id AS seq_id,
                  translate(regexp_replace(upper(regexp_replace(lower(text), '[^acgt]', '', 'g')),
                                           '[^ACGTNacgtn]', 'N', 'g'), 'ACGTNacgtn', 'TGCANtgcan') AS seq
           FROM documents)
SELECT seq_id, {_translate('seq', 0)} AS protein FROM s""")

oracle("read_fasta", r"""
WITH r AS (
  SELECT *, sum(CASE WHEN line LIKE '>%' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS rec_no
  FROM v_fasta_line)
SELECT file_id, CAST(rec_no AS BIGINT) AS rec_no,
       coalesce(arg_min(line, line_no) FILTER (WHERE line LIKE '>%'), '') AS header,
       coalesce(string_agg(CASE WHEN line NOT LIKE '>%' THEN trim(line, ' ' || chr(9) || chr(13)) END, ''
                           ORDER BY line_no), '') AS seq
FROM r GROUP BY file_id, rec_no HAVING seq <> ''""")

oracle("fasta_blocks", r"""
WITH r AS (
  SELECT *, sum(CASE WHEN line LIKE '>%' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS rec_no
  FROM v_fasta_line),
h AS (SELECT file_id, rec_no, line AS header, line_no AS h FROM r WHERE rec_no > 0 AND line LIKE '>%'),
b AS (
  SELECT r.file_id, r.rec_no, coalesce(h.header, '') AS header, CAST(floor((r.line_no - coalesce(h.h, 0) - 1) / 4096) AS BIGINT) AS block,
         string_agg(trim(r.line, ' ' || chr(9) || chr(13)), '' ORDER BY r.line_no) AS seq
  FROM r LEFT JOIN h ON r.file_id = h.file_id AND r.rec_no = h.rec_no
  WHERE r.line NOT LIKE '>%'
  GROUP BY r.file_id, r.rec_no, h.header, CAST(floor((r.line_no - coalesce(h.h, 0) - 1) / 4096) AS BIGINT))
SELECT file_id, CAST(rec_no AS BIGINT) AS rec_no, header, block, seq FROM b WHERE seq <> ''""")
