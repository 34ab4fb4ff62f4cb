"""Small models that tests share."""

import json

from quarry.schema import model_of


def repo(i, name, description=None, path=None):
    return {"id": i, "name": name, "path": path or f"/repos/{name}", "description": description}


def edge(i, src, dst, kind, confidence=None, target_type="repo", source_type="repo", **meta):
    data = ({"confidence": confidence} if confidence else {}) | meta
    return {"id": i, "source_type": source_type, "source_id": src, "target_type": target_type, "target_id": dst, "relationship_type": kind, "metadata": json.dumps(data) if data else None, "repo_id": src}


def topic(i, src, kind, name, confidence="high"):
    return edge(i, src, 0, kind, confidence, "service_name", topic=name, targetName=name)


def unresolved(i, src, kind, name, confidence="low"):
    return edge(i, src, 0, kind, confidence, "service_name", targetName=name, unresolved="true")


def golden(spark):
    """Two services, as a booking system has them."""
    field = lambda i, r, kind, parent, name, type_, null: {"id": i, "repo_id": r, "parent_type": kind, "parent_name": parent, "field_name": name, "field_type": type_, "nullable": null}
    module = lambda i, r, name, type_, **kw: {"id": i, "repo_id": r, "name": name, "type": type_} | kw
    return model_of(
        spark,
        repos=[repo(1, "booking-service", "Handles hotel booking and cancellation"), repo(2, "payments-service", "Payment processing and billing")],
        modules=[
            module(1, 1, "BookingContext.Commands.CreateBooking", "context", summary="Creates a booking, the creation of one"),
            module(2, 1, "BookingContext.Cancellation", "module", summary="Handles booking cancellation"),
            module(3, 2, "PaymentProcessor", "module", summary="Runs payment through the gateway"),
            module(4, 2, "Payments.Schema.Transaction", "schema", table_name="transactions", summary="A payment transaction"),
            module(5, 2, "Payments.Queries.GetTransaction", "graphql_query"),
        ],
        events=[{"id": 1, "repo_id": 1, "name": "BookingCreated", "schema_definition": "message BookingCreated { string booking_id; string guest_name }", "source_file": "proto/b.proto"}],
        services=[{"id": 1, "repo_id": 2, "name": "PaymentGateway", "description": "gRPC service with RPCs: Pay(A) -> B", "service_type": "grpc"}],
        fields=[
            field(1, 1, "proto_message", "BookingCreated", "booking_id", "string", False),
            field(2, 1, "proto_message", "BookingCreated", "guest_name", "string", False),
            field(3, 2, "ecto_schema", "Payments.Schema.Transaction", "amount", "integer", False),
            field(4, 2, "ecto_schema", "Payments.Schema.Transaction", "currency", "string", False),
            field(5, 2, "ecto_schema", "Payments.Schema.Transaction", "status", "string", True),
        ],
        edges=[edge(1, 1, 1, "produces_event", target_type="event"), edge(2, 2, 1, "consumes_event", target_type="event"), edge(3, 2, 1, "calls_grpc", "high")],
        learned_facts=[{"id": 1, "content": "payments-service uses the Stripe API", "repo": "payments-service"}, {"id": 2, "content": "Deploys happen on Tuesday", "repo": None}],
    )
