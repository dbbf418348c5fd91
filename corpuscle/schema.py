"""Explicit schemas: canonical documents, qrels, edges, rankings, metrics and the raw inputs."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(S)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Canonical nested document. ``categorical`` and ``hierarchical`` take several shapes and stay JSON text, so that the
#: order of their keys is kept.
DOCUMENT = _struct(
    id=S, source_dataset=S, source_type=S, title=S, main_text=S, secondary_texts=STRINGS,
    structured_fields=_struct(categorical=S, hierarchical=S),
    entities=_struct(people=STRINGS, organizations=STRINGS, projects=STRINGS, topics=STRINGS),
    relations=_struct(explicit_related_ids=STRINGS),
    retrieval_metadata=_struct(is_queryable=B, is_candidate=B),
    raw_source=_struct(native_id=S, url=S),
)
QREL = _struct(query_id=S, candidate_ids=STRINGS, candidate_id=S, relation_type=S)
EDGE = _struct(src=L, dst=L, relation=S, weight=D)
RANKING = _struct(query_id=L, doc_id=L, score=D, rank=L)
METRIC = _struct(method=S, query_id=S, metric=S, k=L, value=D)

_REPOSITORY = _struct(nameWithOwner=S)
#: Raw issues in their nominal shape.
RAW_ISSUE = _struct(
    issue_no=S, issue_url=S, issue_title=S, issue_body=S, created_at=S, closed_at=S, issue_repository=_REPOSITORY,
    issue_labels=_struct(edges=T.ArrayType(_struct(node=_struct(label=S)))),
    issue_comments=_struct(edges=T.ArrayType(_struct(node=_struct(comment_body=S)))),
    timelineItems=_struct(nodes=T.ArrayType(_struct(pull_info=_struct(
        pull_no=S, pull_url=S, pull_title=S, pull_body=S, repository=_REPOSITORY, createdAt=S, closedAt=S
    )))),
)
#: Paper corpus and paper queries.
PAPER = _struct(corpusid=L, title=S, abstract=S, citations=T.ArrayType(L), full_paper=S)
PAPER_QUERY = _struct(query_set=S, query=S, specificity=S, quality=S, corpusids=T.ArrayType(L))
#: One entry of the metadata cache and of the hierarchy cache.
METADATA = _struct(
    corpusId=L, publicationVenue=_struct(name=S, type=S), fieldsOfStudy=STRINGS, publicationTypes=STRINGS,
    journal=_struct(name=S, volume=S), authors=T.ArrayType(_struct(name=S, affiliations=STRINGS)),
)
HIERARCHY = _struct(hierarchy_info=S, error=S)
BATCH = _struct(
    batch_id=S, input_file_id=S, output_file_id=S, error_file_id=S, status=S, input_path=S, paper_ids=STRINGS, downloaded=B
)
