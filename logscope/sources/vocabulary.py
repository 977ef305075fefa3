"""The known anomaly labels of the service-log dataset (53 labels,
in their published order). Used by ``match_known_label``."""

KNOWN_LABELS = [
    "access token auth header error 401",
    "access token authorization form 401",
    "access token client id not found 404",
    "access token client secret wrong 401",
    "access token form urlencoded 400",
    "access token illegal grant type 400",
    "access token missing authorization header 400",
    "authorization code client id missing 400",
    "authorization code invalid client id 404",
    "authorization code invalid password 401",
    "authorization code missing response type 400",
    "authorization code response not code 400",
    "code challenge invalid format pkce 400",
    "code challenge too long pkce 400",
    "code challenge too short pkce 400",
    "code verifier missing pkce 400",
    "code verifier too long pkce 400",
    "code verifier too short pkce 400",
    "delete client 404 no client",
    "delete service 404 no service",
    "delete token 404",
    "delete user 404 no user",
    "get client 404 no client",
    "get client page 400 no page",
    "get service 404 no service",
    "get service page 400 no page",
    "get token 404",
    "get token page 400 no page",
    "get user 404 no user",
    "get user page 400 no page",
    "invalid code challenge method pkce 400",
    "invalid code verifier format PKCE 400",
    "register client 400 clientProfile",
    "register client 400 clientType",
    "register client 404 no user",
    "register service 400 service id",
    "register service 400 service type",
    "register service 404 no user",
    "register user 400 email exists",
    "register user 400 no password",
    "register user 400 password no match",
    "register user 400 user exists",
    "update client 400 clientProfile",
    "update client 400 clientType",
    "update client 404 clientId",
    "update client 404 ownerId",
    "update password 400 not match",
    "update password 401 wrong password",
    "update password 404 user not found",
    "update service 404 service id",
    "update service 404 user id",
    "update user 404 no user",
    "verification failed pkce 400",
]
