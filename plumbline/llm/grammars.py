"""Grammars and lexers of the supported languages, for gll.Grammar."""

from __future__ import annotations

import re

from plumbline.llm.gll import Grammar

# --- ECMAScript and its typed dialect -------------------------------------------------------------------------------------------------

_ECMA = """
Module = NL? Item*
Script = NL? ( Item | Return )*
Item = Plain | Import | Export {T | ( 'export'? 'default'? Signature )+ 'export'? 'default'? 'async'? Func }
Import = 'import' ( STR | Name ( ',' ( C[Specs] | '*' 'as' Name ) )? 'from' STR | ( C[Specs] | '*' 'as' Name ) 'from' STR {T | 'type' ( Name | C[Specs] | '*' 'as' Name ) 'from' STR | Name '=' Expr } ) Attributes? @T
Attributes = ( 'with' | 'assert' ) C[Obj]
Specs = ( Spec ( ',' Spec )* ','? )? NL?
Spec = {T 'type'? } ( @Word | STR ) ( 'as' ( @Word | STR ) )?
Export = 'export' ( 'default' ( Func | Class | 'async' Func | AssignNB @T {T | Interface | 'abstract' Class } ) | C[Specs] ( 'from' STR Attributes? )? @T | '*' ( 'as' ( @Word | STR ) )? 'from' STR Attributes? @T | Decl {T | 'type' C[Specs] ( 'from' STR )? @T | '=' Expr @T | 'as' 'namespace' Name @T } )
Decl = Var @T | Func | 'async' Func | Class {T | Interface | Alias | Enum | Space | 'declare' ( Decl | Signature | AmbientSpace ) | 'abstract' Class }
Stmts = NL? Stmt*
Stmt = Plain | Return
Return = 'return' Expr? @T
Plain = ';' | NL | C[Stmts] | Decl | If | For | While | Do | Switch | Try | Decorator Class | 'throw' Expr @T | ( 'break' | 'continue' ) Name? @T | 'debugger' @T | 'with' P[Expr] Stmt | Name ':' Stmt | ExprNB @T
Var = ( 'var' | 'let' | 'const' ) Binding ( ',' Binding )*
Binding = Target {T '!'? Ann? } ( '=' Assign )?
Target = Name | B[ArrayPattern] | C[ObjPattern]
ArrayPattern = ','* ( Element ( ','+ Element )* ','* )? NL?
Element = '...'? Target ( '=' Assign )?
ObjPattern = ( PatternProp ( ',' PatternProp )* ','? )? NL?
PatternProp = '...' Target | Name ( '=' Assign )? | PropKey ':' Target ( '=' Assign )?
If = 'if' P[Expr] NL? Stmt ( 'else' Stmt )?
For = 'for' 'await'? P[ForHead] NL? Stmt
ForHead = ( Var | Expr )? ';' Expr? ';' Expr? | ( ( 'var' | 'let' | 'const' ) Target | Expr ) 'of' Assign | ( 'var' | 'let' | 'const' ) Target 'in' Expr | Expr
While = 'while' P[Expr] NL? Stmt
Do = 'do' Stmt NL? 'while' P[Expr] @T?
Switch = 'switch' P[Expr] C[Cases]
Cases = NL? ( 'case' Expr ':' Stmt* | 'default' ':' Stmt* )*
Try = 'try' C[Stmts] ( 'catch' P[CatchHead]? C[Stmts] ( 'finally' C[Stmts] )? | 'finally' C[Stmts] )
CatchHead = Target {T Ann? }
Func = 'function' '*'? Name? {T TypeParams? } P[Params] {T Ann? } C[Stmts]
Params = ( Param ( ',' Param )* ','? )? NL?
Param = Decorator* {T @Modifier* } '...'? {T ( 'this' Ann? | Target '?'? Ann? ) } {J Target } ( '=' Assign )?
Class = 'class' Name? {T TypeParams? } ( 'extends' Postfix {T TypeArgs? } )? {T ( 'implements' Type ( ',' Type )* )? } C[ClassBody]
ClassBody = Member*
Member = ';' | NL | 'static' C[Stmts] | Decorator | {T @Modifier* } {J 'static'? } ( 'async'? '*'? | 'get' | 'set' ) PropKey {T '?'? TypeParams? } P[Params] {T Ann? ( C[Stmts] | @T ) } {J C[Stmts] } | {T @Modifier* } {J 'static'? } PropKey {T ( '?' | '!' )? Ann? } ( '=' Assign )? @T {T | @Modifier* B[IndexKey] Ann @T }
Decorator = '@' Name ( '.' @Word )* P[Args]? NL?
PropKey = @Word | STR | NUM | B[Assign1] | PRIVATE
Assign1 = Assign NL?
Expr = Assign ( ',' Assign )* NL?
ExprNB = AssignNB ( ',' Assign )*
Assign = Unary Rest | Arrow
AssignNB = UnaryNB Rest | Arrow
Rest = ( @Bin Unary {T | ( 'as' | 'satisfies' ) ( Type | 'const' ) } )* ( '?' Assign ':' Assign | @Assign Assign )? | ( @Bin Unary )* ( @Bin | @Assign ) Arrow
Arrow = 'async'? ( Name | {T TypeParams? } P[Params] {T Ann? } ) '=>' ( C[Stmts] | Assign )
Unary = @Pre Unary | 'yield' '*'? Unary? | Postfix {A | '<' ( Type | 'const' ) '>' Unary }
UnaryNB = @Pre Unary | 'yield' '*'? Unary? | PostfixNB {A | '<' ( Type | 'const' ) '>' Unary }
Postfix = ( PrimaryNB | C[Obj] | FuncExpr | Class ) Tail*
PostfixNB = PrimaryNB Tail*
FuncExpr = 'async'? Func
Tail = '.' ( @Word | PRIVATE ) | '?.' ( @Word | PRIVATE | B[Expr] | P[Args] ) | B[Expr] | P[Args] | TEMPLATE | '++' | '--' {T | '!' | TypeArgs P[Args] }
PrimaryNB = Name | NUM | STR | TEMPLATE | REGEX | JSX | PRIVATE | 'this' | 'super' | 'null' | 'true' | 'false' | P[Expr] | B[Array] | 'new' ( '.' Name | Postfix {T TypeArgs? P[Args]? } ) | 'import' ( P[Args] | '.' Name ) | 'async' FuncExpr
Args = ( '...'? Assign ( ',' '...'? Assign )* ','? )? NL?
Array = ','* ( '...'? Assign ( ','+ '...'? Assign )* ','* )? NL?
Obj = ( Prop ( ',' Prop )* ','? )? NL?
Prop = '...' Assign | Name ( '=' Assign )? | PropKey ':' Assign | ( 'async'? '*'? | 'get' | 'set' ) PropKey {T TypeParams? } P[Params] {T Ann? } C[Stmts]
Name = ID | @Soft
@Soft = 'of' | 'get' | 'set' | 'static' | 'async' | 'from' | 'as' | 'type' | 'interface' | 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly' | 'private' | 'public' | 'protected' | 'override' | 'keyof' | 'infer' | 'is' | 'satisfies' | 'implements' | 'unique' | 'asserts' | 'assert' | 'let' | 'yield' | 'await' | 'accessor'
@Word = ID | @Soft | 'import' | 'export' | 'default' | 'if' | 'else' | 'for' | 'while' | 'do' | 'switch' | 'case' | 'try' | 'catch' | 'finally' | 'function' | 'class' | 'extends' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof' | 'return' | 'throw' | 'break' | 'continue' | 'debugger' | 'with' | 'var' | 'const' | 'this' | 'super' | 'null' | 'true' | 'false' | 'enum'
@T = ';' | NL
@Pre = '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' {T NL? } | 'delete' | 'await'
@Bin = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '<=' | '>' '>'? '>'? {T NL? } | '>' '=' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | 'in' | 'instanceof'
@Assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '&&=' | '||=' | '??=' | '>' '>' '='  | '>' '>' '>' '='
@Modifier = 'public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'async' | 'accessor'
"""
_TYPES = """
Interface = 'interface' Name TypeParams? ( 'extends' Type ( ',' Type )* )? C[TypeBody]
Alias = 'type' Name TypeParams? '=' Type @T
Enum = 'const'? 'enum' Name C[EnumBody]
EnumBody = ( PropKey ( '=' Assign )? ( ',' PropKey ( '=' Assign )? )* ','? )? NL?
Space = ( 'namespace' | 'module' ) ( Name ( '.' @Word )* | STR ) C[Module]
AmbientSpace = ( 'namespace' | 'module' ) ( Name ( '.' @Word )* | STR ) C[Ambient] | 'global' C[Ambient]
Ambient = NL? ( Item | 'export'? 'default'? Signature )*
Signature = 'async'? 'function' '*'? Name TypeParams? P[Params] Ann? @T
Ann = ':' 'asserts'? Type
TypeParams = '<' TypeParam ( ',' TypeParam )* ','? '>'
TypeParam = ( 'const' | 'in' )? Name ( 'extends' Type )? ( '=' Type )?
TypeArgs = '<' Type ( ',' Type )* '>'
Type = ( '|' | '&' )? TypeUnit ( ( '|' | '&' ) TypeUnit )* ( 'extends' Type '?' Type ':' Type )? | ( Name | 'this' ) 'is' Type | FuncType
FuncType = ( 'abstract'? 'new' )? TypeParams? P[Params] '=>' Type
TypeUnit = ( 'keyof' | 'readonly' | 'unique' | 'infer' ) TypeUnit | TypePrimary B[TypeIndex]*
TypePrimary = @Word ( '.' @Word )* TypeArgs? | STR | '-'? NUM | TEMPLATE | C[TypeBody] | B[Tuple] | P[TypeIn] | 'typeof' ( @Word | 'import' P[Args] ) ( '.' @Word )* TypeArgs? | 'import' P[Args] ( '.' @Word )* TypeArgs?
TypeIn = Type NL?
TypeIndex = Type? NL?
Tuple = ( TupleItem ( ',' TupleItem )* ','? )? NL?
TupleItem = '...'? ( Name '?'? ':' )? Type '?'?
TypeBody = ( TypeMember ( ( ';' | ',' | NL )+ TypeMember )* )? ( ';' | ',' | NL )*
TypeMember = ( 'readonly' | '-' 'readonly' | '+' 'readonly' )? ( PropKey ( '?' | '-' '?' | '+' '?' )? ( TypeParams? P[Params] )? Ann? | B[IndexKey] ( '?' | '-' '?' )? Ann ) | 'new'? TypeParams? P[Params] Ann? | ( 'get' | 'set' ) PropKey P[Params] Ann?
IndexKey = Name ( ':' Type | 'in' Type ( 'as' Type )? ) NL?
"""


def _dialect(text: str, keep: str) -> str:
    """Text with ``{X ...}`` parts of the dialects ``keep`` opened and those of the others dropped."""
    return re.sub(r"\{([TJA])\s([^{}]*)\}", lambda m: m[2] if m[1] in keep else "", text)


_EC_CLASSES = ("ID", "NUM", "STR", "TEMPLATE", "REGEX", "JSX", "PRIVATE", "NL")

# --- Go -------------------------------------------------------------------------------------------------------------------------------

_GO = """
File = ';'? 'package' ID ';' ( Import ';' )* ( Top ( ';' Top )* )? ';'?
Import = 'import' ( ImportSpec | P[ImportSpecs] )
ImportSpecs = ( ImportSpec ( ';' ImportSpec )* )? ';'?
ImportSpec = ( ID | '.' )? STR
Top = 'func' ID TypeParams? Sig C[Block]? | 'func' P[Params] ID Sig C[Block]? | Decl
Decl = 'var' ( VarSpec | P[VarSpecs] ) | 'const' ( ConstSpec | P[ConstSpecs] ) | 'type' ( TypeSpec | P[TypeSpecs] )
VarSpecs = ( VarSpec ( ';' VarSpec )* )? ';'?
VarSpec = Ids ( Type ( '=' Exprs )? | '=' Exprs )
ConstSpecs = ( ConstSpec ( ';' ConstSpec )* )? ';'?
ConstSpec = Ids ( Type? '=' Exprs )?
TypeSpecs = ( TypeSpec ( ';' TypeSpec )* )? ';'?
TypeSpec = ID TypeParams? '='? Type
TypeParams = B[TypeParamList]
TypeParamList = ( Ids Constraint ( ',' Ids Constraint )* ','? )? ';'?
Constraint = '~'? Type ( '|' '~'? Type )*
Ids = ID ( ',' ID )*
Sig = P[Params] ( Type | P[Params] )?
Params = ( Param ( ',' Param )* ','? )?
Param = ID? '...'? Type
Type = ID ( '.' ID )? B[TypeList]? | '*' Type | B[ArrayLen] Type | 'map' B[Type1] Type | '<-'? 'chan' '<-'? Type | 'func' Sig | 'struct' C[Fields] | 'interface' C[Methods] | P[Type1]
Type1 = Type
TypeList = Type ( ',' Type )* ','?
ArrayLen = ( Expr | '...' )?
Fields = ( Field ( ';' Field )* )? ';'?
Field = ( Ids Type | '*'? ID ( '.' ID )? B[TypeList]? ) STR?
Methods = ( Method ( ';' Method )* )? ';'?
Method = ID Sig | Constraint
Block = ( Stmt? ( ';' Stmt? )* )
Stmt = Decl | Simple | 'return' Exprs? | If | For | Switch | Select | ( 'go' | 'defer' ) Expr | ( 'break' | 'continue' ) ID? | 'goto' ID | 'fallthrough' | C[Block] | ID ':' Stmt?
Simple = Exprs ( ( ':=' | @Assign ) Exprs | '++' | '--' | '<-' Expr )?
If = 'if' ( Simple? ';' )? Expr C[Block] ( 'else' ( If | C[Block] ) )?
For = 'for' ( Simple? ';' Expr? ';' Simple? | ( Exprs ( ':=' | '=' ) )? 'range' Expr | Expr )? C[Block]
Switch = 'switch' ( Simple? ';' )? ( ( ID ':=' )? Expr )? C[Cases]
Cases = ( ( 'case' ( ExprOrType ( ',' ExprOrType )* ) | 'default' ) ':' Block )*
Select = 'select' C[Comms]
Comms = ( ( 'case' Simple | 'default' ) ':' Block )*
ExprOrType = Expr | Type
Exprs = Expr ( ',' Expr )*
Expr = Unary ( @Bin Unary )*
Unary = ( '+' | '-' | '!' | '^' | '*' | '&' | '<-' )* Primary
Primary = Operand Tail*
Operand = ID | NUM | STR | RUNE | P[Inner] | 'func' Sig C[Block]? | ( B[ArrayLen] Type | 'map' B[Type1] Type | 'chan' Type | 'struct' C[Fields] | 'interface' C[Methods] ) ( C[Elems] | P[Args] )?
Inner = ExprOrType
Tail = '.' ( ID | P[Assertion] ) | B[Index] | P[Args] | C[Elems]
Assertion = Type | 'type'
Index = ( ExprOrType ( ',' ExprOrType )* ','? ) | Expr? ':' Expr? ( ':' Expr )?
Args = ( ExprOrType ( ',' ExprOrType )* '...'? ','? )?
Elems = ( Elem ( ',' Elem )* ','? )?
Elem = ( Expr | C[Elems] ) ( ':' ( Expr | C[Elems] ) )?
@Bin = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&^' | '<<' | '>>' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '&&' | '||'
@Assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '&^=' | '<<=' | '>>='
"""

# --- Rust -----------------------------------------------------------------------------------------------------------------------------

_RUST = """
File = InnerAttr* Item*
Items = InnerAttr* Item*
InnerAttr = '#' '!' B[Tokens]
Attr = '#' B[Tokens]
Vis = 'pub' P[VisIn]?
VisIn = 'crate' | 'self' | 'super' | 'in' SimplePath
Item = ';' | Attr | Vis? ( Use | Fn | Struct | Enum | Union | Trait | Impl | Mod | Const | Static | Alias | ExternCrate | ExternBlock | Macro )
Use = 'use' UseTree ';'
UseTree = '::'? ( PathWord '::' )* ( PathWord ( 'as' ( ID | '_' ) )? | '*' | C[UseList] )
UseList = ( UseTree ( ',' UseTree )* ','? )?
PathWord = ID | 'crate' | 'self' | 'super' | 'union' | 'auto' | 'raw' | 'box'
SimplePath = '::'? PathWord ( '::' PathWord )*
Fn = ( 'const' | 'async' | 'unsafe' | 'extern' STR? )* 'fn' Ident Generics? P[Params] ( '->' Type )? Where? ( C[Block] | ';' )
Params = ( Attr* Param ( ',' Attr* Param )* ','? )?
Param = '&' LIFETIME? 'mut'? 'self' | 'mut'? 'self' ( ':' Type )? | Pattern ':' Type | '...' | Type
Generics = '<' ( GenericParam ( ',' GenericParam )* ','? )? '>'
GenericParam = Attr* ( LIFETIME ( ':' Bounds? )? | Ident ( ':' Bounds? )? ( '=' Type )? | 'const' Ident ':' Type ( '=' Expr )? )
Where = 'where' ( WherePart ( ',' WherePart )* ','? )?
WherePart = ( LIFETIME | ForLife? Type ) ':' Bounds?
ForLife = 'for' Generics
Bounds = Bound ( '+' Bound )* '+'?
Bound = LIFETIME | '?'? ForLife? TypePath | P[Bound1]
Bound1 = Bound
Struct = 'struct' Ident Generics? ( Where? ( C[Fields] | ';' ) | P[TupleFields] Where? ';' )
Union = 'union' Ident Generics? Where? C[Fields]
Fields = ( Attr* Vis? Ident ':' Type ( ',' Attr* Vis? Ident ':' Type )* ','? )?
TupleFields = ( Attr* Vis? Type ( ',' Attr* Vis? Type )* ','? )?
Enum = 'enum' Ident Generics? Where? C[Variants]
Variants = ( Variant ( ',' Variant )* ','? )?
Variant = Attr* Vis? Ident ( P[TupleFields] | C[Fields] )? ( '=' Expr )?
Trait = 'unsafe'? 'auto'? 'trait' Ident Generics? ( ':' Bounds? )? Where? C[Items]
Impl = 'unsafe'? 'impl' Generics? ( '!'? Type 'for' )? Type Where? C[Items]
Mod = 'unsafe'? 'mod' Ident ( ';' | C[Items] )
Const = 'const' ( Ident | '_' ) ':' Type ( '=' Expr )? ';'
Static = 'static' 'mut'? Ident ':' Type ( '=' Expr )? ';'
Alias = 'type' Ident Generics? ( ':' Bounds? )? Where? ( '=' Type )? Where? ';'
ExternCrate = 'extern' 'crate' PathWord ( 'as' ( ID | '_' ) )? ';'
ExternBlock = 'unsafe'? 'extern' STR? C[Items]
Macro = SimplePath '!' Ident? ( C[Tokens] | ( P[Tokens] | B[Tokens] ) ';' )
Tokens = ( @Any | P[Tokens] | B[Tokens] | C[Tokens] )*
Type = TypeUnit ( '+' Bound )*
TypeUnit = TypePath | '&' LIFETIME? 'mut'? TypeUnit | '&&' LIFETIME? 'mut'? TypeUnit | '*' ( 'const' | 'mut' ) TypeUnit | B[ArrayType] | P[TupleType] | '!' | '_' | ForLife? ( 'unsafe' | 'extern' STR? )* 'fn' P[Params] ( '->' Type )? | ( 'dyn' | 'impl' ) Bounds | '<' Type ( 'as' TypePath )? '>' ( '::' PathSeg )+ | Ident '!' P[Tokens]
ArrayType = Type ( ';' Expr )?
TupleType = ( Type ( ',' Type )* ','? )?
TypePath = '::'? PathSeg ( '::' PathSeg )*
PathSeg = PathWord ( '::'? GenericArgs | P[TupleType] ( '->' TypeUnit )? )?
GenericArgs = '<' ( GenericArg ( ',' GenericArg )* ','? )? '>'
GenericArg = LIFETIME | Type | '-'? NUM | STR | 'true' | 'false' | C[Block] | Ident GenericArgs? ( '=' Type | ':' Bounds )
Pattern = '|'? PatternUnit ( '|' PatternUnit )*
PatternUnit = '_' | '..' | Literal ( ( '..=' | '..' | '...' ) Literal? )? | '..=' Literal | 'ref'? 'mut'? Ident ( '@' PatternUnit )? | ( '&' | '&&' ) 'mut'? PatternUnit | P[Patterns] | B[Patterns] | ExprPath ( P[Patterns] | C[FieldPatterns] | ( '..=' | '..' ) ( Literal | ExprPath )? )? | Ident '!' ( P[Tokens] | B[Tokens] ) | 'box' PatternUnit
Patterns = ( Attr* Pattern ( ',' Attr* Pattern )* ','? )?
FieldPatterns = ( Attr* ( '..' | 'ref'? 'mut'? Ident | ( Ident | NUM ) ':' Pattern ) ( ',' Attr* ( '..' | 'ref'? 'mut'? Ident | ( Ident | NUM ) ':' Pattern ) )* ','? )?
Literal = '-'? NUM | STR | CHAR | 'true' | 'false'
Block = InnerAttr* Stmt* Last?
Stmt = ';' | Attr | Vis? ( Use | Fn | Struct | Enum | Trait | Impl | Mod | Const | Static | Alias ) | Let ';' | Blocky '?'? | MacroBraced | Expr ';'
Last = Expr
Let = 'let' Pattern ( ':' Type )? ( '=' Expr ( 'else' C[Block] )? )?
MacroBraced = SimplePath '!' Ident? C[Tokens]
Blocky = ( LIFETIME ':' )? ( C[Block] | 'unsafe' C[Block] | 'async' 'move'? C[Block] | 'const' C[Block] | If | Match | 'loop' C[Block] | 'while' Cond C[Block] | 'for' Pattern 'in' ExprNS C[Block] )
If = 'if' Cond C[Block] ( 'else' ( If | C[Block] ) )?
Cond = CondPart ( ( '&&' | '||' ) CondPart )*
CondPart = 'let' Pattern '=' ExprNS | ExprNS
Match = 'match' ExprNS C[Arms]
Arms = InnerAttr* ( Arm* ArmLast? )
Arm = Attr* Pattern ( 'if' Cond )? '=>' ( Expr ',' | Blocky ','? )
ArmLast = Attr* Pattern ( 'if' Cond )? '=>' Expr
Expr = Range
Range = Binary ( ( '..' | '..=' ) Binary? )? | ( '..' | '..=' ) Binary? | Closure | Jump
Binary = Unary ( @Bin Unary | 'as' TypeUnit )* ( @Assign Expr | @Bin ( Closure | Jump ) )?
Unary = ( '-' | '!' | '*' | ( '&' | '&&' ) ( 'mut' | 'raw' ( 'const' | 'mut' ) )? )* ( Postfix | Closure )
Postfix = ( Primary | ExprPath C[StructExpr] ) Tail*
ExprNS = RangeNS
RangeNS = BinaryNS ( ( '..' | '..=' ) BinaryNS? )? | ( '..' | '..=' ) BinaryNS? | Closure | Jump
BinaryNS = UnaryNS ( @Bin UnaryNS | 'as' TypeUnit )* ( @Assign ExprNS )?
UnaryNS = ( '-' | '!' | '*' | ( '&' | '&&' ) 'mut'? )* PostfixNS
PostfixNS = Primary Tail*
Tail = '?' | '.' ( Ident ( '::' GenericArgs )? P[Args]? | NUM | 'await' ) | P[Args] | B[Index]
Args = ( Expr ( ',' Expr )* ','? )?
Index = Expr
Primary = Literal | ExprPath | P[Tuple] | B[Array] | Blocky | SimplePath '!' ( P[Tokens] | B[Tokens] | C[Tokens] )
Tuple = ( Expr ( ',' Expr )* ','? )?
Array = ( Expr ( ',' Expr )* ','? | Expr ';' Expr )?
ExprPath = ( '<' Type ( 'as' TypePath )? '>' '::' | '::' )? ExprSeg ( '::' ExprSeg )*
ExprSeg = PathWord ( '::' GenericArgs )?
StructExpr = ( Attr* FieldExpr ( ',' Attr* FieldExpr )* ','? )?
FieldExpr = '..' Expr? | Ident | ( Ident | NUM ) ':' Expr
Closure = 'static'? 'async'? 'move'? ( '||' | '|' ( ClosureParam ( ',' ClosureParam )* ','? )? '|' ) ( '->' TypeUnit C[Block] | Expr )
ClosureParam = PatternUnit ( ':' Type )?
Jump = 'return' Expr? | 'break' LIFETIME? Expr? | 'continue' LIFETIME?
Ident = ID | 'union' | 'auto' | 'raw' | 'box'
@Bin = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<' '<'? | '>' '>'? | '==' | '!=' | '<=' | '>=' | '&&' | '||'
@Assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='
"""

# --- Java -----------------------------------------------------------------------------------------------------------------------------

_JAVA = """
File = ( Annotation* 'package' Path ';' )? ( Import | ';' )* ( TypeDecl | ';' )* | Annotation* 'open'? 'module' Path C[Tokens]
Import = 'import' 'static'? Path ( '.' '*' )? ';'
Path = Ident ( '.' Ident )*
Tokens = ( ID | '.' | ',' | ';' | @Soft )*
Annotation = '@' Path P[AnnArgs]?
AnnArgs = ( ( Ident '=' )? AnnValue ( ',' ( Ident '=' )? AnnValue )* ','? )?
AnnValue = Cond | Annotation | C[AnnValues]
AnnValues = ( AnnValue ( ',' AnnValue )* ','? )?
@Mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed'
Mods = ( @Mod | Annotation )*
TypeDecl = Mods ( 'class' Ident TypeParams? ( 'extends' Type )? Impls? Permits? C[ClassBody] | 'interface' Ident TypeParams? ( 'extends' Types )? Permits? C[ClassBody] | 'enum' Ident Impls? C[EnumBody] | 'record' Ident TypeParams? P[Params] Impls? C[ClassBody] | '@' 'interface' Ident C[ClassBody] )
Impls = 'implements' Types
Permits = 'permits' Types
Types = Type ( ',' Type )*
TypeParams = '<' TypeParam ( ',' TypeParam )* '>'
TypeParam = Annotation* Ident ( 'extends' Type ( '&' Type )* )?
ClassBody = Member*
EnumBody = ( EnumConst ( ',' EnumConst )* )? ','? ( ';' Member* )?
EnumConst = Annotation* Ident P[Args]? C[ClassBody]?
Member = ';' | 'static'? C[Block] | TypeDecl | Mods TypeParams? ( Ident P[Params] Throws? C[Block] | Ident C[Block] | ( Type | 'void' ) Ident P[Params] B[Empty]* Throws? ( C[Block] | ( 'default' AnnValue )? ';' ) | Type Declarators ';' )
Throws = 'throws' Types
Empty = 
Params = ( Param ( ',' Param )* )?
Param = Mods ( Type ( Annotation* '...' )? ( Ident | ( Ident '.' )? 'this' ) B[Empty]* )
Declarators = Ident B[Empty]* ( '=' Init )? ( ',' Ident B[Empty]* ( '=' Init )? )*
Init = Expr | C[ArrayInit]
ArrayInit = ( Init ( ',' Init )* )? ','?
Type = Annotation* ( @Prim | ClassType ) ( Annotation* B[Empty] )*
ClassType = Ident TypeArgs? ( '.' Annotation* Ident TypeArgs? )*
TypeArgs = '<' ( TypeArg ( ',' TypeArg )* )? '>'
TypeArg = Annotation* '?' ( ( 'extends' | 'super' ) Type )? | Type
@Prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
Block = Stmt*
Stmt = ';' | C[Block] | TypeDecl | Local ';' | If | 'for' P[ForHead] Stmt | 'while' P[Expr1] Stmt | 'do' Stmt 'while' P[Expr1] ';' | Switch | Try | 'return' Expr? ';' | 'throw' Expr ';' | ( 'break' | 'continue' ) Ident? ';' | 'yield' Expr ';' | 'synchronized' P[Expr1] C[Block] | 'assert' Expr ( ':' Expr )? ';' | Ident ':' Stmt | Effect ';'
Local = Mods Type Declarators
If = 'if' P[Expr1] Stmt ( 'else' Stmt )?
ForHead = ( Local | Effects )? ';' Expr? ';' Effects? | Mods Type Ident ':' Expr
Effects = Expr ( ',' Expr )*
Effect = Unary ( @Assign Expr )?
Expr1 = Expr
Switch = 'switch' P[Expr1] C[Cases]
Cases = Case*
Case = ( 'case' Label ( ',' Label )* ( ID Expr )? | 'default' ) ( ':' Stmt* | '->' ( Expr ';' | C[Block] | 'throw' Expr ';' ) )
Label = Cond | 'default' | Pattern
Pattern = Mods Type ( Ident | P[Patterns] Ident? )
Patterns = ( Pattern ( ',' Pattern )* )?
Try = 'try' P[Resources]? C[Block] ( 'catch' P[Catch] C[Block] )* ( 'finally' C[Block] )?
Resources = Resource ( ';' Resource )* ';'?
Resource = Mods Type Ident '=' Expr | Expr
Catch = Mods Type ( '|' Type )* Ident
Expr = Cond ( @Assign Expr )? | Lambda
Lambda = ( Ident | P[LambdaParams] ) '->' ( Expr | C[Block] )
LambdaParams = ( Ident ( ',' Ident )* )? | Params
Cond = Unary ( @Bin Unary | 'instanceof' ( Pattern | 'final'? Type ) )* ( '?' ( Lambda | Cond ) ':' ( Lambda | Cond ) )?
Unary = ( '+' | '-' | '++' | '--' | '!' | '~' | P[CastType] )* ( Primary Tail* ( '++' | '--' )* | P[CastType] Lambda )
CastType = Type ( '&' Type )*
Primary = NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | Ident | P[Expr1] | New | Switch | ( @Prim | ClassType ) B[Empty]* ( '.' 'class' | '::' ( 'new' | Ident ) ) | 'void' '.' 'class'
New = 'new' Annotation* ( ClassType P[Args] C[ClassBody]? | ( @Prim | ClassType ) ( B[Expr1]+ B[Empty]* | B[Empty]+ C[ArrayInit] ) )
Tail = '.' ( TypeArgs? Ident | 'this' | 'super' | 'class' | New ) | P[Args] | B[Expr1] | '::' TypeArgs? ( Ident | 'new' )
Args = ( Expr ( ',' Expr )* )?
Ident = ID | @Soft
@Soft = 'record' | 'sealed' | 'permits' | 'yield' | 'module' | 'open'
@Bin = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' '<'? | '>' '>'? '>'? | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^'
@Assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>='
"""

# --- Python ---------------------------------------------------------------------------------------------------------------------------

_PYTHON = """
File = Stmt*
Suite = Stmt+
Stmt = Simple NL | Compound
Simple = Small ( ';' Small )* ';'?
Small = Exprs | ( Targets '=' )+ ( Exprs | Yield ) | Place ( @Aug ( Exprs | Yield ) | ':' Test ( '=' ( Exprs | Yield ) )? ) | Yield | 'pass' | 'break' | 'continue' | 'return' Exprs? | 'raise' ( Test ( 'from' Test )? )? | ( 'global' | 'nonlocal' ) Name ( ',' Name )* | 'del' Exprs | 'assert' Test ( ',' Test )? | 'import' Dotted ( 'as' Name )? ( ',' Dotted ( 'as' Name )? )* | 'from' ( Dots Dotted? | Dotted ) 'import' ( '*' | P[Aliases] | Alias ( ',' Alias )* ) | 'type' Name B[TypeParams]? '=' Test
Dots = ( '.' | '...' )+
Aliases = Alias ( ',' Alias )* ','?
Alias = Name ( 'as' Name )?
Dotted = Name ( '.' Name )*
Block = ':' ( Simple NL | NL I[Suite] )
Compound = 'if' Named Block ( 'elif' Named Block )* ( 'else' Block )? | 'while' Named Block ( 'else' Block )? | 'async'? 'for' Targets 'in' Exprs Block ( 'else' Block )? | Try | 'async'? 'with' ( P[WithItems] | WithItem ( ',' WithItem )* ) Block | Def | Decorated | 'match' Exprs ':' NL I[Cases]
Try = 'try' Block ( ( 'except' '*'? ( Exprs ( 'as' Name )? )? Block )+ ( 'else' Block )? ( 'finally' Block )? | 'finally' Block )
WithItems = WithItem ( ',' WithItem )* ','?
WithItem = Test ( 'as' Target )?
Decorated = ( '@' Named NL )+ Def
Def = 'async'? 'def' Name B[TypeParams]? P[Params] ( '->' Test )? Block | 'class' Name B[TypeParams]? P[Args]? Block
TypeParams = TypeParam ( ',' TypeParam )* ','?
TypeParam = ( '*' | '**' )? Name ( ':' Test )? ( '=' Test )?
Params = ( Param ( ',' Param )* ','? )?
Param = '/' | '*' | ( '*' | '**' )? Name ( ':' '*'? Test )? ( '=' Test )?
LambdaParams = ( LambdaParam ( ',' LambdaParam )* ','? )?
LambdaParam = '/' | '*' | ( '*' | '**' )? Name ( '=' Test )?
Cases = ( 'case' Patterns ( 'if' Named )? Block )+
Patterns = PatternAs ( ',' PatternAs )* ','?
PatternAs = Pattern ( '|' Pattern )* ( 'as' Name )?
Pattern = '*' Name | '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | 'None' | 'True' | 'False' | Dotted ( P[PatternArgs] )? | P[PatternList] | B[PatternList] | C[PatternMap]
PatternList = Patterns?
PatternArgs = ( ( Name '=' )? PatternAs ( ',' ( Name '=' )? PatternAs )* ','? )?
PatternMap = ( ( '**' Name | ( '-'? NUM | STR+ | 'None' | 'True' | 'False' | Dotted ) ':' PatternAs ) ( ',' ( '**' Name | ( '-'? NUM | STR+ | 'None' | 'True' | 'False' | Dotted ) ':' PatternAs ) )* ','? )?
Yield = 'yield' ( 'from' Test | Exprs )?
Exprs = Star ( ',' Star )* ','?
Star = '*' Bin | Named
Targets = Target ( ',' Target )* ','?
Target = '*'? ( Place | B[Targets0] | P[Targets0] )
Targets0 = Targets?
Place = Name | Atom Tail* ( '.' Name | B[Index] ) | P[Place1]
Place1 = Place
Named = Test | Name ':=' Test
Test = Or ( 'if' Or 'else' Test )? | 'lambda' LambdaParams ':' Test
Or = Not ( ( 'or' | 'and' ) Not )*
Not = 'not'* Compare
Compare = Bin ( ( '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ) Bin )*
Bin = Unary ( ( '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%' | '//' | '@' | '**' ) Unary )*
Unary = ( '+' | '-' | '~' )* 'await'? Atom Tail*
Atom = Name | NUM | STR+ | '...' | 'None' | 'True' | 'False' | P[Paren] | B[List] | C[Dict]
Paren = ( Yield | Exprs | Named Comp )?
List = ( Exprs | Named Comp )?
Dict = ( Exprs | Named Comp | Pair ( ',' Pair )* ','? | Test ':' Test Comp )?
Pair = Test ':' Test | '**' Bin
Comp = ( 'async'? 'for' Targets 'in' Or ( 'if' CompIf )* )+
CompIf = Or | Name ':=' Test | 'lambda' LambdaParams ':' Or
Tail = '.' Name | P[Args] | B[Index]
Args = ( Arg ( ',' Arg )* ','? )?
Arg = Named Comp? | Name '=' Test | '*' Test | '**' Test
Index = IndexItem ( ',' IndexItem )* ','?
IndexItem = '*' Bin | Named | Test? ':' Test? ( ':' Test? )?
Name = ID | 'match' | 'case' | 'type'
@Aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
"""

_JSON = """
File = Value
Value = STR | NUM | 'true' | 'false' | 'null' | C[Members] | B[Elements]
Members = ( STR ':' Value ( ',' STR ':' Value )* )?
Elements = ( Value ( ',' Value )* )?
"""

_TOML = """
File = ( ( Key '=' Value | B[Header] )? NL )*
Header = Key | B[Key]
Key = ( KEY | STR ) ( '.' ( KEY | STR ) )*
Value = VALUE | STR | LONG | B[Array] | C[Inline]
Array = NL* ( Value NL* ( ',' NL* Value NL* )* ( ',' NL* )? )?
Inline = ( Key '=' Value ( ',' Key '=' Value )* )?
"""

#: Lines of block YAML by their shape; an indented block is a group.
_YAML = """
File = ( MARK? Node? ( MARK Node? )* )
Node = Block | Flow | Prop+ ( Flow | Block )?
Block = Map | Seq
Map = ( KEY Prop* ( Flow | TEXT | I[Node] | Seq )? )+
Seq = ( DASH Prop* ( Flow | TEXT | I[Node] )? )+
Prop = ANCHOR | TAG
Flow = SCALAR | STR | ALIAS | B[FlowSeq] | C[FlowMap]
FlowSeq = ( FlowItem ( ',' FlowItem )* ','? )?
FlowItem = Prop* Flow? ( ':' Prop* Flow? )? | Prop+
FlowMap = ( FlowPair ( ',' FlowPair )* ','? )?
FlowPair = Prop* Flow ( ':' Prop* Flow? )? | '?' Flow ( ':' Flow? )?
"""


_JOINS = ("else", "catch", "finally", "while", "instanceof", "in", "as", "satisfies", "of", "from", "extends", "implements")


def build(language: str) -> Grammar:
    """The grammar of a language of LANGUAGES."""
    if language == "javascript":
        return Grammar(_dialect(_ECMA, "J"), _EC_CLASSES, ("Module", "Script", "Stmts", "ClassBody"), (";", "NL"), _JOINS)
    if language in ("typescript", "typescript+jsx"):  # angle-bracket assertions and JSX exclude each other
        return Grammar(_dialect(_ECMA, "TA" if language == "typescript" else "T") + _TYPES, _EC_CLASSES, ("Module", "Stmts", "ClassBody"), (";", "NL"), _JOINS)
    if language == "go":
        return Grammar(_GO, ("ID", "NUM", "STR", "RUNE"), ("Block",), (";",), _JOINS)
    if language == "rust":
        g = _RUST
        words = sorted(set(re.findall(r"'([^']+)'", g)))
        return Grammar(g + "\n@Any = ID | NUM | STR | CHAR | LIFETIME | '$' | '~' | '#' | " + " | ".join(f"'{w}'" for w in words), ("ID", "NUM", "STR", "CHAR", "LIFETIME"), ("File", "Items", "Block"), (";",), _JOINS)
    if language == "java":
        return Grammar(_JAVA, ("ID", "NUM", "STR", "CHAR"), ("ClassBody", "Block"), (";",), _JOINS)
    if language == "python":
        return Grammar(_PYTHON, ("ID", "NUM", "STR", "NL"), ("File", "Suite"), ("NL",), ("elif", "else", "except", "finally"))
    if language == "json":
        return Grammar(_JSON, ("STR", "NUM"))
    if language == "toml":
        return Grammar(_TOML, ("KEY", "STR", "LONG", "VALUE", "NL"), ("File",), ("NL",))
    if language == "yaml":
        return Grammar(_YAML, ("KEY", "DASH", "SCALAR", "STR", "TEXT", "ALIAS", "ANCHOR", "TAG", "MARK"))
    raise ValueError(f"no grammar for {language}")
